import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.sources import readers, sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_word_entries(spark, tmp_path):
    rows = [{"id": "a", "headword": " Alpha ", "plain_text": "", "paragraphs": [{"text": " one "}, {"text": ""}, {"text": "two"}], "source_pages": ["3", "x", "3"]}, {"headword": "Beta", "plain_text": "b"}]
    path = write(f"{tmp_path}/w/w.jsonl", "\ufeff" + "\n\n".join(map(json.dumps, rows)) + "\n")
    got = {r["entry_id"]: r for r in readers.word_entries(spark, path).collect()}
    assert got["a"]["headword_key"] == "alpha" and got["a"]["plain_text"] == "one\ntwo" and got["a"]["source_pages"] == [3]
    assert got["Beta"]["display_headword"] == "Beta" and got["Beta"]["related_targets"] == []
    with pytest.raises(Exception, match="id and headword|FAILFAST|[Mm]alformed"):
        readers.word_entries(spark, write(f"{tmp_path}/w/bad.jsonl", '{"id": "x"}\n')).collect()


def card(**changes):
    side = lambda t: {"primary": t, "follow_ups": [f"{t}?", "more"]}
    return {"id": "q1", "kind": "question", "ordinal": 4, "source": {"language": "en", "primary": "why", "follow_ups": ["more"]}, "languages": {"en": side("a"), "ja": side("b"), "zh": side("c")}} | changes


def test_card_book(spark, tmp_path):
    path = write(f"{tmp_path}/c/c.jsonl", json.dumps(card()))
    row = readers.card_book(spark, path, "question").first()
    assert row["follow_ups"] == ["more", "a?", "b?", "c?"] and row["ordinal"] == 4
    for bad in (card(kind="other"), card(ordinal="x"), card(languages={})):
        with pytest.raises(Exception, match="reviewed"):
            readers.card_book(spark, write(f"{tmp_path}/c/bad.jsonl", json.dumps(bad))).collect()
    with pytest.raises(Exception, match="reviewed"):
        readers.card_book(spark, path, "answer").collect()


def test_morphology(spark, tmp_path):
    rows = [{"id": "1", "headword": "a", "cells": ["x", "y"], "source_page": "n"}, {"id": "2", "headword": "b", "cells": ["alpha 1 beta 2"]}, {"id": "", "headword": "c", "cells": ["z"]}]
    got = readers.morphology(spark, write(f"{tmp_path}/m/m.jsonl", "\n".join(map(json.dumps, rows)))).collect()
    assert [(r["record_id"], r["content"], r["source_page"]) for r in got] == [("1", "x y", 0)]


def test_tei(spark, tmp_path):
    entry = lambda orth, *quotes: f"<entry><form><orth>{orth}</orth></form><sense>{''.join(f'<cit type=\"{k}\"><quote>{q}</quote></cit>' for k, q in quotes)}</sense></entry>"
    body = entry("House", ("trans", "bayt"), ("example", "no")) + entry("house", ("trans", "Bayt"), ("trans", "dar"))
    path = write(f"{tmp_path}/t/t.xml", f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>{body}</body></text></TEI>')
    got = sorted((r["headword_key"], r["translation_key"]) for r in readers.tei_dictionary(spark, path).collect())
    assert got == [("house", "bayt"), ("house", "dar")]


def test_jmdict(spark, tmp_path):
    word = {
        "id": "1", "kanji": [{"text": "明日", "common": True}, {"text": "朙日"}], "kana": [{"text": "あした", "appliesToKanji": ["*"]}, {"text": "あす", "appliesToKanji": ["明日"]}],
        "sense": [{"appliesToKanji": ["*"], "appliesToKana": [], "partOfSpeech": ["n"], "gloss": [{"lang": "eng", "text": "tomorrow"}, {"lang": "ger", "text": "morgen"}]}, {"appliesToKana": ["あす"], "partOfSpeech": ["n"], "gloss": [{"lang": "eng", "text": "near future"}]}],
    }
    path = write(f"{tmp_path}/j/j.json", json.dumps({"words": [word, {"id": "2", "kana": [{"text": "かな"}], "sense": []}]}))
    got = {(r["form"], r["reading"]): r for r in readers.jmdict(spark, path).collect()}
    assert set(got) == {("明日", "あした"), ("明日", "あす"), ("朙日", "あした"), ("かな", "かな")}
    assert got["明日", "あす"]["glosses"] == ["tomorrow", "near future"] and got["明日", "あした"]["glosses"] == ["tomorrow"] and got["明日", "あした"]["common"]


def test_markdown(spark, tmp_path):
    note = "intro\n# One\n```\n# no\n[[hidden]]\n```\n[[Target|Label]] `[[code]]` <!-- [[gone]] -->\n> ## Not a heading\n## Two ##\n[[Plain]]\n"
    write(f"{tmp_path}/v/a/n.md", note)
    write(f"{tmp_path}/v/.hid/x.md", "# x")
    write(f"{tmp_path}/v/a/x.txt", "# x")
    files = readers.markdown_files(spark, f"{tmp_path}/v")
    assert [r["path"] for r in files.collect()] == ["a/n.md"]
    sections = readers.markdown_sections(files)
    got = sorted((r["line_start"], r["line_end"], r["level"], r["heading"]) for r in sections.collect())
    assert got == [(1, 1, 0, "(document)"), (2, 8, 1, "One"), (9, 10, 2, "Two")]
    assert sorted((r["target"], r["label"]) for r in readers.wiki_links(sections).collect()) == [("Plain", "Plain"), ("Target", "Label")]
    before = readers.tree_fingerprint(files)
    write(f"{tmp_path}/v/b.md", "x")
    assert readers.tree_fingerprint(readers.markdown_files(spark, f"{tmp_path}/v")) != before


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert [r["line"] for r in sinks.canonical_json(df, "k").collect()] == ['{"k":1,"v":null}', '{"k":2,"v":"b"}']
    manifest = sinks.release({"t": (df, ("k",))}, f"{tmp_path}/out", "Test")
    assert manifest["tables"]["t"]["rows"] == 2
    import hashlib

    listed = dict(reversed(line.split("  ")) for line in open(f"{tmp_path}/out/SHA256SUMS").read().splitlines())
    assert {"manifest.json", "README.md"} < set(listed) and any(n.startswith("t/part-") for n in listed)
    assert all(hashlib.sha256(open(f"{tmp_path}/out/{name}", "rb").read()).hexdigest() == digest for name, digest in listed.items())
    assert manifest["tables"]["t"]["rows"] == df.count()
    with pytest.raises(RuntimeError):
        sinks.swapped_in(spark, f"{tmp_path}/out", lambda folder: (_ for _ in ()).throw(RuntimeError("lost")))
    assert os.path.exists(f"{tmp_path}/out/manifest.json")


def test_a_released_table_is_one_file_in_order(spark, tmp_path):
    import hashlib

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so that sorting leaves several partitions
    try:
        df = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("k")).repartition(3)
        manifest = sinks.release({"t": (df, ("k",)), "none": (df.where("id < 0"), ("k",))}, f"file://{tmp_path}/out", "Test")
        parts = sinks.release({"t": (df, ("k",))}, f"file://{tmp_path}/parts", "Test", 100)
    finally:
        spark.conf.unset(coalesce)
    listed = dict(reversed(line.split("  ")) for line in open(f"{tmp_path}/out/SHA256SUMS").read().splitlines())
    assert sorted(n.split("/")[0] for n in listed) == ["README.md", "manifest.json", "none", "t"]
    assert all(hashlib.sha256(open(f"{tmp_path}/out/{name}", "rb").read()).hexdigest() == digest for name, digest in listed.items())
    for table, rows in {"t": 1000, "none": 0}.items():
        (file,) = [p for p in (tmp_path / "out" / table).iterdir() if p.name.startswith("part-")]
        assert [json.loads(line)["k"] for line in file.read_text().splitlines()] == list(range(rows))
        assert listed[f"{table}/{file.name}"] == manifest["tables"][table]["logical_sha256"]
    assert parts["tables"]["t"] == manifest["tables"]["t"] and len(open(f"{tmp_path}/parts/SHA256SUMS").read().splitlines()) >= 12


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red house"), (2, "blue house")], "id int, text string")
    meta = sinks.build_index(docs, f"{tmp_path}/index", "id", {"text": 1.0})
    assert meta["rows"] == 2 and spark.read.parquet(f"{tmp_path}/index/postings").where("term = 'house'").count() == 2
    assert [r["id"] for r in search.bm25(docs, "id", {"text": 1.0}, "bl").collect()] == [2]


def test_equal_names_are_found_by_id(spark):
    """What points, degree and label leave equal goes by id, however the rows lie in partitions."""
    nodes = spark.createDataFrame([(i * 37 % 101, "a widget" if i % 2 else "A Widget", 5 if i < 90 else None) for i in range(101)], "id bigint, label string, degree int")
    first = sorted(i * 37 % 101 for i in range(90))[:7]
    for n in (1, 3, 8):
        assert [r["id"] for r in search.name_search(nodes.repartition(n, "label"), "Widget", 7).collect()] == first


def test_a_failed_swap_leaves_what_was_there(spark, tmp_path):

    def put(text):
        return lambda folder: sinks.put_text(spark, f"{folder}/x", text)

    path = f"{tmp_path}/place"
    sinks.swapped_in(spark, path, put("one"))
    with pytest.raises(ZeroDivisionError):
        sinks.swapped_in(spark, path, lambda folder: 1 / 0)
    assert open(f"{path}/x").read() == "one"
    sinks.swapped_in(spark, path, put("two"))
    assert open(f"{path}/x").read() == "two" and [p.name for p in tmp_path.iterdir()] == ["place"]


def test_headings_fences_and_links():
    text = "intro\n## \n #  not one\n# One #\n> ```\n> # code\n# Two\n~~~\n# code\n~~~ x\n[[in code]]\n~~~\n[[a|b]] \\[[c]] [[d]] `[[e]]` <!-- [[f]] -->\n    [[g]]\n> [[h]]\n"
    got = [(s["heading"], s["line_start"], s["line_end"]) for s in readers.split_sections(text)]
    assert got == [("(document)", 1, 3), ("One", 4, 6), ("Two", 7, 15)]
    assert [(p["target"], p["label"]) for p in readers.find_links(text)] == [("a", "b"), ("d", "d"), ("h", "h")]


def test_sqlite_release_and_backup(spark, tmp_path):
    import sqlite3

    words = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, word string")
    good = spark.createDataFrame([(10, 1, 0.5), (11, 2, None)], "id bigint, of bigint, score double")
    file, copy = f"{tmp_path}/r.db", f"{tmp_path}/copy.db"
    assert sinks.sqlite_release({"word": (words, "id", {}), "part": (good, "id", {"of": "word"})}, file) == {"word": 2, "part": 2}
    bad = spark.createDataFrame([(12, 9, 0.1)], "id bigint, of bigint, score double")
    with pytest.raises(ValueError):
        sinks.sqlite_release({"word": (words, "id", {}), "part": (bad, "id", {"of": "word"})}, file)
    sinks.sqlite_backup(file, copy)
    with sqlite3.connect(copy) as db:
        assert db.execute("SELECT word, score FROM part JOIN word ON word.id = part.of ORDER BY part.id").fetchall() == [("a", 0.5), (None, None)]
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix == ".db") == ["copy.db", "r.db"]


def test_markdown_index_is_built_once_and_by_one(spark, tmp_path, monkeypatch):
    write(tmp_path / "notes" / "a.md", "# Alpha\nsome words [[b]]\n# Beta\nother words\n")
    root, place = f"file://{tmp_path}/notes", f"file://{tmp_path}/index"
    first = sinks.build_markdown_index(spark, root, place)
    assert first["built"] and first["sections"] == 2
    assert not sinks.build_markdown_index(spark, root, place)["built"]
    found = sinks.search_index(spark, f"{place}/sections", "other beta").collect()
    assert len(found) == 1
    with sinks.locked(spark, place), pytest.raises(RuntimeError):
        sinks.build_markdown_index(spark, root, place)
    write(tmp_path / "notes" / "b.md", "# Gamma\n")
    real = readers.tree_fingerprint
    seen = []
    monkeypatch.setattr(readers, "tree_fingerprint", lambda files: f"{real(files)}{seen.append(1) or len(seen)}")
    with pytest.raises(ValueError):
        sinks.build_markdown_index(spark, root, place)
    monkeypatch.undo()
    assert spark.read.parquet(f"{place}/sections/entries").count() == 2
    assert sinks.build_markdown_index(spark, root, place)["sections"] == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["index", "notes"]
