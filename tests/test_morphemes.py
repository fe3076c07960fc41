from pyspark.sql import functions as F

from corpusloom.operators import morphemes as M


def test_book_text_to_graph(spark):
    records = spark.createDataFrame(
        [
            (1, "predict", "predict* [pri] pre- (= before) + dict (= say); speaker ［s］ speak（＝talk） -er (=one who)"),
            (2, "dict", "\\mathrm{dict} (= say) words"),
            (3, "none", "no components here"),
            (4, "undo", "undo [u] -un (= not) do (= act, make)"),
            (5, None, None),
        ],
        "record_id bigint, headword string, content string",
    )
    lexicon = spark.createDataFrame([("dict", "root", ["say"]), ("speak", "root", ["talk"]), ("speak", "suffix", ["talk"]), ("do", "root", ["act"])], "form string, kind string, gloss array<string>")
    rows = M.typed(M.observations(records), lexicon)
    got = {(r["record_id"], r["clause"], r["ordinal"]): (r["term"], r["raw_form"], r["kind"], r["confidence"], r["state"]) for r in rows.collect()}
    assert got == {
        (1, 0, 0): ("predict", "pre-", "prefix", 0.99, "materializable"), (1, 0, 1): ("predict", "dict", "root", 0.99, "materializable"),
        (1, 1, 0): ("speaker", "speak", "ambiguous", 0.0, "observed"), (1, 1, 1): ("speaker", "-er", "suffix", 0.99, "materializable"),
        (2, 0, 0): ("dict", "dict", "root", 0.99, "materializable"), (4, 0, 0): ("undo", "-un", "suffix", 0.99, "observed"), (4, 0, 1): ("undo", "do", "root", 0.95, "materializable"),
    }
    entities, edges = M.typed_graph(rows)
    assert {(e["source"], e["target"], e["ordinal"]) for e in edges.collect()} == {("term:predict", "prefix:pre-", 0), ("term:predict", "root:dict", 1), ("term:speaker", "suffix:-er", 1), ("term:dict", "root:dict", 0), ("term:undo", "root:do", 1)}
    assert entities.where(F.col("kind") == "term").count() == 4 and entities.count() == 8
    assert M.observations(records.limit(0)).count() == 0
