from pyspark.sql import functions as F

from corpusloom.operators import authority as A
from corpusloom.operators import graph as G
from corpusloom.operators import jobs as J
from corpusloom.operators import relational as R


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reduction_and_scope(spark):
    supports = spark.createDataFrame(
        [("a", "1", "accepted", "model", 0.9, "m", ["e1"]), ("a", "2", "accepted", "book", 0.4, "b", ["e2", "e1"]), ("b", "3", "retired", "book", 0.5, "x", [])],
        "assertion_id string, support_id string, status string, basis string, confidence double, properties string, evidence array<string>",
    )
    claims = spark.createDataFrame([("a",), ("b",), ("c",)], "assertion_id string")
    got = {r["assertion_id"]: r for r in A.reduced(claims, supports).collect()}
    assert (got["a"]["action"], got["a"]["basis"], got["a"]["confidence"], got["a"]["properties"], got["a"]["evidence"]) == ("accept", "book", 0.9, "b", ["e1", "e2"])
    assert (got["b"]["action"], got["c"]["action"]) == ("archive", "skip")


def test_slot_decisions(spark):
    earlier = "array<struct<prompt_version: string, evidence: string>>"
    proposals = spark.createDataFrame(
        [
            ("1", "s", "exclusive", "model", "y", "v1", "e", []), ("2", "s", "exclusive", "book", "y", "v1", "e", []), ("3", "s", "exclusive", "book", "x", "v1", "e", []), ("4", "s", "set-member", "book", "y", "v1", "e", []),
            ("5", "m", "exclusive", "model", "y", "v1", "e", []), ("6", "m", "exclusive", "model", "y", "v2", "f", [("v1", "e")]), ("7", "m", "exclusive", "model", "y", "v1", "e", [("v1", "e")]),
            ("8", "m", "exclusive", "book", "x", "v1", "e", []), ("9", "new", "exclusive", "model", "x", "v1", "e", []),
        ],
        f"proposal_id string, slot string, mode string, basis string, target string, prompt_version string, evidence string, earlier {earlier}",
    )
    incumbents = spark.createDataFrame([("s", "book", "x"), ("m", "model", "x")], "slot string, basis string, target string")
    got = dict(rows(A.slot_decisions(proposals, incumbents), "proposal_id", "decision"))
    assert got == {"1": "keep", "2": "conflict", "3": "noop", "4": "coexist", "5": "pending", "6": "supersede", "7": "pending", "8": "update", "9": "accept"}


def test_greedy_spans(spark):
    spans = spark.createDataFrame([("w", 1, 0, 4, 0.5, "a"), ("w", 2, 3, 6, 0.9, "b"), ("w", 3, 4, 7, 0.1, "c"), ("w", 4, 0, 4, 0.5, "a")], "group string, span_id long, start int, end int, confidence double, identity string")
    assert rows(A.greedy_spans(spans), "span_id", "chosen") == [(1, True), (2, False), (3, True), (4, True)]


def test_span_greedy_sees_every_word(spark, tmp_path):
    from corpusloom.plans.claims import span_greedy

    texts = [(1, "One two banana, extraordinarily a; banana"), (2, "banana"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    confidence = lambda parts: {r["p"]: r["c"] for r in spark.createDataFrame([(p,) for p in parts], "p string").select("p", (F.pmod(F.xxhash64("p"), F.lit(100)) / 100).alias("c")).collect()}

    def greedy(word):
        n = len(word)
        parts = [word[:k] for k in range(1, min(8, n) + 1)] + [word[n - k :] for k in range(1, min(8, n) + 1)] + [word[i : i + k] for k in range(3, min(8, n) + 1) for i in range(n - k + 1)]
        parts, kept, out = list(dict.fromkeys(parts)), [], {}
        sure = confidence(parts)
        for p, i in sorted(((p, i) for i, p in enumerate(parts)), key=lambda x: (-len(x[0]), -sure[x[0]], x[0], x[1])):
            span = (word.index(p), word.index(p) + len(p))
            out[i] = all(span[1] <= a or b <= span[0] for a, b in kept)
            kept += [span] if out[i] else []
        return out

    wanted = [(f"{d}:{w}", i, c) for d, ws in ((1, ["one", "two", "banana", "extraordinarily", "a"]), (2, ["banana"])) for w in ws for i, c in greedy(w).items()]
    assert rows(span_greedy(spark, str(tmp_path)), "group", "span_id", "chosen") == sorted(wanted)


JOBS = "job_id string, job_type string, subject_key string, status string, attempts int, max_attempts int, priority int, created_at int"


def test_jobs(spark):
    jobs = spark.createDataFrame(
        [("a", "prepare", "x", "failed", 2, 2, 1, 1), ("b", "prepare", "x", "queued", 0, 2, 1, 1), ("c", "prepare", "x", "queued", 0, 2, 1, 1), ("d", "compose-word-card", "x", "queued", 0, 2, 1, 1), ("e", "prepare", "term:z", "queued", 1, 2, 9, 9), ("f", "prepare", "x", "queued", 2, 2, 0, 0)],
        JOBS,
    )
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "job_id string, depends_on string")
    assert rows(J.ready(jobs, needs), "job_id") == [("d",), ("e",)]
    assert [r["job_id"] for r in J.in_order(J.ready(jobs, needs)).collect()] == ["e", "d"]
    assert rows(J.failed_through(jobs, needs), "job_id") == [("b",), ("c",)]
    claimed = {r["job_id"]: r for r in J.claim(jobs, needs).collect()}
    assert (claimed["e"]["status"], claimed["e"]["attempts"]) == ("running", 2)
    assert rows(J.requeued(jobs, ["a", "b"]).where("attempts = 0 and status = 'queued'"), "job_id") == [("a",), ("b",), ("c",), ("d",)]
    assert J.enqueued(jobs, jobs.limit(2), "job_id").count() == 6


def test_graph_caps_and_closure(spark):
    claims = spark.createDataFrame([("s", f"c{i:02}", "s", f"n{i}", "r") for i in range(40)] + [("s", "d", "n1", "far", "r")], "subject string, claim_id string, src string, dst string, relation string")
    got = G.subgraph(claims, max_depth=1).collect()
    assert len(got) == 23 and all(r["truncated"] for r in got)
    assert len(G.subgraph(claims, max_depth=1, most_nodes=100).collect()) == 32
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert rows(G.closure(cycle, spark.createDataFrame([(1,)], "id int")), "id") == [(1,), (2,), (3,)]
    assert rows(G.components(cycle, spark.createDataFrame([(1,), (6,), (9,)], "id int")), "id", "component") == [(1, 1), (6, 5), (9, 9)]
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "place int, id string")
    edges = spark.createDataFrame([(1, "a", "b", "r"), (2, "a", "b", "r"), (3, "a", "z", "r")], "place int, src string, dst string, relation string")
    own, kept = G.deduplicated(nodes, edges)
    assert rows(own, "place") == [(1,), (2,)] and rows(kept, "place") == [(1,)]


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, t int, v string")
    assert rows(R.latest(df, ["k"], "t").where("v is null"), "k", "t") == [("a", 2)]
    new = spark.createDataFrame([("b", 9, "z"), ("c", 1, "q"), ("c", 2, "r")], "k string, t int, v string")
    assert rows(R.insert_ignore(df, new, ["k"]).where("k = 'c'"), "k") == [("c",)]
    facts = spark.createDataFrame([("a", 5), ("a", 0)], "k string, at int")
    got = dict(rows(R.as_of(facts, df.select("k", "t", "v"), ["k"], "at", "t"), "at", "t"))
    assert got == {5: 2, 0: None}
    assert spark.range(1).select(R.overlaps(F.lit(0), F.lit(2), F.lit(2), F.lit(3))).first()[0] is False


_PARTS = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"


def band_join(spark, parts, folder):
    from corpusloom.plans import catalog

    spark.createDataFrame(parts, _PARTS).write.parquet(f"{folder}/part.parquet")
    return catalog.QUERIES["band_join_levenshtein"](spark, str(folder))


def test_band_join_equals_sql_on_odd_rows(spark, tmp_path):
    """Nulls, equal names at other sizes, copies, sizes below 0 and a key met twice."""
    import duckdb

    from corpusloom.plans import catalog

    names, kinds = ["ab", "abc", "abd", "xyz", "", None, "ab"], ["SMALL", "PROMOC", None]
    parts = [(None if i % 41 == 0 else i - i % 2 if i % 29 == 0 else i, names[i % 7], f"b{i % 2}" if i % 23 else None, kinds[(i // 2) % 16 // 7], (i * 37 % 61) - 20 if i % 19 else None) for i in range(1, 240)]
    parts += [(1000 + i, "ab", "b0", "SMALL", 5) for i in range(4)] + [(2000, None, "alone", "SMALL", 5), (2001, "ab", "alone", "SMALL", 13), (2002, None, "alone", "SMALL", 22)]
    got = sorted(tuple(r) for r in band_join(spark, parts, tmp_path).select("a_key", "b_key", "distance", "gap").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert [str(r) for r in got] == [str(r) for r in sorted(db.execute(catalog.ORACLES["band_join_levenshtein"]).fetchall())]
    assert {r[0]: r[1:] for r in got}[2000] == (2001, None, 8)


def test_band_join_makes_no_pairs_of_copies(spark, tmp_path):
    n = 1500
    df = band_join(spark, [(i, "red bolt", "b", "SMALL", 1 + i % 2) for i in range(n)], tmp_path)
    assert {r["a_key"]: (r["b_key"], r["distance"], r["gap"]) for r in df.collect()} == {i: (i % 2 + 2 * (i < 2), 0, 0) for i in range(n)}
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    made = []
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        if nodes.apply(i).name().endswith("Join"):
            made += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    assert made and max(made) <= 2 * n


def test_whole_graphs_see_every_row(spark, tmp_path):
    from corpusloom.plans import graphs

    put = lambda name, data, kind: spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    items = [(1, 1, 5.0), (1, 2, 1.0), (2, 2, 7.0), (2, 3, 1.0), (3, 3, 2.0), (9, 9, 1.0)]
    put("lineitem", items, "l_partkey bigint, l_suppkey bigint, l_quantity double")
    orders = [(1, 1), (2, 1), (23, 2), (1501, 3)]
    put("orders", orders, "o_orderkey bigint, o_custkey bigint")
    turns = [(c, t) for c in (1, 2, 3) for t in range(c + 1)]
    put("conversations", turns, "conv_id bigint, turn bigint")
    depth, near = {"s1": 0}, [(f"p{p}", f"s{s}") for p, s, _ in items]
    for step in (1, 2, 3):
        known = set(depth)
        for a, b in near + [(b, a) for a, b in near]:
            if a in known:
                depth.setdefault(b, step)
    assert dict(rows(graphs.bfs_depth_k(spark, str(tmp_path)), "id", "depth")) == depth
    wanted = {n: f"c{c}" for o, c in orders for n in (f"c{c}", f"o{o}")}
    assert dict(rows(graphs.components(spark, str(tmp_path)), "id", "component")) == wanted
    assert rows(graphs.recursive_lineage(spark, str(tmp_path)), "id") == sorted((c * 1000 + t,) for c, t in turns)


def test_owner_scope_sees_every_order(spark, tmp_path):
    from corpusloom.plans.claims import owner_scope_replace

    orders = [(1, "F", "5-LOW"), (2, "F", "1-URGENT"), (250, "O", "1-URGENT"), (999, "P", "2-HIGH"), (5000, "F", "5-LOW"), (5001, "F", "2-HIGH"), (5002, "P", "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    wanted = [("b", k, "accepted") for k, s, _ in orders if s != "F"] + [("a", k, "retired") for k, s, p in orders if s == "F" and p == "5-LOW"]
    wanted += [("a", k, "accepted") for k, s, p in orders if s != "O" and p != "5-LOW"]
    assert rows(owner_scope_replace(spark, str(tmp_path)), "owner", "assertion_id", "status") == sorted(wanted)


def plain_walk(subject, claims, depth, nodes, edges, scanned):
    """A walk in so many words: node by node in the order found, claim by claim in the order of their names."""
    claims = sorted(claims, key=lambda c: (c[3], c[1], c[2], c[0]))[:scanned]
    found, order, taken = {subject: 0}, [subject], {}
    for node in order:
        for name, a, b, _ in sorted(claims):
            if len(taken) == edges or found[node] == depth:
                break
            far = {a: b, b: a}.get(node)
            if far is None or name in taken or (far not in found and len(found) == nodes):
                continue
            if far not in found:
                found[far] = found[node] + 1
                order.append(far)
            taken[name] = found[far]
    return taken


def test_bounded_subgraph_against_a_plain_walk(spark):
    import random

    r = random.Random(9)
    rows, wanted = [], {}
    for s in range(30):
        subject, size = f"s{s}", r.choice([3, 10, 60])
        name = lambda: r.choice([subject, *[f"n{i}" for i in range(size)]])  # noqa: B023, E731
        claims = {f"c{i:03d}": (f"c{i:03d}", name(), name(), r.choice("ab")) for i in range(r.randint(1, 90))}
        rows += [(subject, *c) for c in claims.values()]
        wanted[subject] = plain_walk(subject, list(claims.values()), 3, 12, 20, 50)
    got = G.subgraph(spark.createDataFrame(rows, "subject string, claim_id string, src string, dst string, relation string"), 3, 12, 20, 50).collect()
    for subject, taken in wanted.items():
        assert {g["claim_id"]: g["depth"] for g in got if g["subject"] == subject} == taken


def test_greedy_spans_against_a_plain_loop(spark):
    import random

    from corpusloom.operators import authority as A

    r = random.Random(2)
    spans = [(f"g{i % 12}", i, a, a + r.randint(1, 5), r.choice([0.1, 0.5, 0.9]), r.choice("xy")) for i in range(300) for a in [r.randint(0, 8)]]
    wanted = {}
    for group in {s[0] for s in spans}:
        kept = []
        for _, n, a, b, sure, who in sorted((s for s in spans if s[0] == group), key=lambda s: (s[2] - s[3], -s[4], s[5], s[1])):
            wanted[n] = all((a, b, who) == k or b <= k[0] or k[1] <= a for k in kept)
            kept += [(a, b, who)] if wanted[n] else []
    got = A.greedy_spans(spark.createDataFrame(spans, "group string, span_id bigint, start int, end int, confidence double, identity string")).collect()
    assert {g["span_id"]: g["chosen"] for g in got} == wanted


def test_draw_batch_against_a_plain_ring(spark):
    import hashlib

    from corpusloom.operators import search

    ids = list(range(0, 90, 3))
    docs = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    for seed, limit in (("a", 1), ("b", 6), ("c", 40)):
        excluded, drawn = {0, 9, 30}, []
        for i in range(limit):
            start = int.from_bytes(hashlib.sha256(f"book\0{seed if limit == 1 else f'{seed}:{i}'}".encode()).digest()[:8]) % len(ids)
            ring = [x for x in ids[start:] + ids[:start] if x not in excluded and x not in drawn]
            drawn += ring[:1]
        assert search.draw_batch(docs, ["id"], seed, "book", spark.createDataFrame([(x,) for x in excluded], "id bigint"), "id", limit) == drawn


def test_arguments_and_draws():
    import pytest

    from corpusloom.operators import policies, selection

    assert selection.validated("  a  b ", "EN", 20, 5) == ("a b", "en", 5)
    for bad in (("", "en", 20, 5), ("a", "not a tag", 20, 5), ("a", "en", 20, 0), ("a", "en", 20, 21), ("a", "en", 20, True), ("x" * 301, "en", 20, 5)):
        with pytest.raises(ValueError):
            selection.validated(*bad)
    pool, seen = list(range(40)), []
    draw = lambda out: next((x for x in pool if x not in out), None)
    assert policies.drawn_until(lambda x: seen.append(x) or x == 3, draw) == 3 and seen == [0, 1, 2, 3]
    assert policies.drawn_until(lambda x: False, draw) is None
    with pytest.raises(ValueError):
        policies.by_policy("nothing", {}, "a")
