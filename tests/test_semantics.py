"""Semantics on small literal frames."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.functions import scrub as R
from loomstone.functions import text as T
from loomstone.operators import beliefs as B
from loomstone.operators import graph as G
from loomstone.operators import oplog as O
from loomstone.operators import search as S
from loomstone.operators import signing as K
from loomstone.operators import similarity as M
from loomstone.sources import transcripts as TR
from loomstone.streaming import live as L


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EDGE = "src long, dst long, rel string, weight double"


def test_two_strong_hops_beat_one_weak(spark):
    adj = frame(spark, [(1, 2, "explains", 0.9), (2, 3, "explains", 0.9), (1, 3, "explains", 0.5)], EDGE)
    best = {r["id"]: r["score"] for r in G.best_paths(adj, frame(spark, [(1,)], "id long"), 2).collect()}
    assert best[3] == pytest.approx(0.81)
    assert best[1] == 1.0


def test_path_score_is_a_product_not_a_minimum(spark):
    adj = frame(spark, [(1, 2, "explains", 0.5), (2, 3, "explains", 0.5)], EDGE)
    assert {r["id"]: r["score"] for r in G.best_paths(adj, frame(spark, [(1,)], "id long"), 2).collect()}[3] == pytest.approx(0.25)


def test_support_is_never_certain(spark):
    rows = [(1, 2, "explains", f"s{i}") for i in range(50)] + [(1, 2, "explains", "s0")]
    r = G.edge_support(frame(spark, rows, "src long, dst long, rel string, session_id string")).first()
    assert r["n"] == 50 and r["weight"] == 0.99


def test_large_session_is_no_corroboration(spark):
    rows = [("big", i) for i in range(9)] + [("small", i) for i in range(3)]
    assert G.co_derived(frame(spark, rows, "session_id string, belief_id long")).count() == 3


def test_components_and_singletons(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60), "x", 1.0) for _ in range(40)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in G.components(spark.range(60), frame(spark, edges, EDGE)).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_repoint_drops_loops_and_reorders(spark):
    edges = frame(spark, [(1, 2, "explains"), (5, 2, "contradicts"), (1, 3, "explains")], "src long, dst long, rel string")
    got = {tuple(r) for r in G.repoint(edges, frame(spark, [(1, 3), (5, 1)], "old long, new long")).collect()}
    assert got == {(3, 2, "explains"), (1, 2, "contradicts")}


def test_no_outcomes_returns_the_prior_and_stale_does_not_flip(spark):
    beliefs = frame(spark, [(1, 0.8, "active"), (2, 0.8, "active"), (3, 0.8, "retracted")], "id long, confidence double, status string")
    outcomes = frame(spark, [(2, "stale"), (2, "stale"), (2, "stale"), (3, "contradicted"), (3, "contradicted"), (2, "bogus")], "belief_id long, event string")
    assert B.calibrated(beliefs, outcomes).where("id = 1").first()["posterior"] == pytest.approx(0.8)
    assert {r["id"]: r["new_status"] for r in B.contradicted_dormant(beliefs, outcomes).collect()} == {1: "active", 2: "active", 3: "retracted"}


def test_empty_tables(spark):
    b = frame(spark, [], "id long, subject string, claim string, confidence double, status string, superseded_by long")
    o = frame(spark, [], "belief_id long, event string")
    assert B.calibration_curve(b, o).count() == 0
    assert G.components(frame(spark, [], "id long"), frame(spark, [], EDGE)).count() == 0
    assert S.bm25(frame(spark, [], "id long, claim string"), ["id"], "claim", ["a"]).count() == 0


def test_similarity_kernel_against_all_pairs(spark):
    random.seed(5)
    rows = [(i, "x" if i % 2 else "y", random.sample("abcdefgh", random.randrange(0, 7))) for i in range(60)]
    df = frame(spark, rows, "id long, block string, toks array<string>")
    for t in (0.5, 0.6, 0.85, 1.0):
        got = {(r["a"], r["b"]): r["score"] for r in M.covering_pairs(df, df, t).collect()}
        want = {(a, b): len(set(x) & set(y)) / len(x) for a, g, x in rows for b, h, y in rows if a != b and g == h and x and y and len(set(x) & set(y)) / len(x) >= t}
        assert got == pytest.approx(want)


def test_exact_threshold_is_kept(spark):
    df = frame(spark, [(1, "s", list("abcde")), (2, "s", list("abcxyz"))], "id long, block string, toks array<string>")
    assert M.covering_pairs(df, df, 0.6).count() == 1


def test_scrub_rules():
    c = R.conditional
    assert c('password = "my long secret phrase"') == 'password = "[REDACTED:value]"'
    assert c("AWS_SECRET_ACCESS_KEY=abcdefghijk") == "AWS_SECRET_ACCESS_KEY=[REDACTED:value]"
    assert c("token: op://vault/item") == "token: op://vault/item"
    assert c("api_key=${MY_TOKEN}") == "api_key=${MY_TOKEN}"
    assert c('{"password": "abcdefgh1"}') == '{"password": "[REDACTED:value]"}'
    assert c("x " + "a1" * 20) == "x [REDACTED:hex]"
    finger = "SHA256:" + "Ab+/" * 10 + "xyz"
    assert c(finger) == finger
    assert c("/usr/share/applications/documents/storage/contents") == "/usr/share/applications/documents/storage/contents"
    assert c("abcdefghij/klmnopqrstuvwxyz0123456789ABCDEFGHIJ") == "[REDACTED:base64]"
    assert c("monkey=abcdefghijk") == "monkey=abcdefghijk"


def test_scrub_before_cut(spark):
    text = "x" * 30 + " sk-" + "A" * 30
    row = frame(spark, [(text,), (None,), ("",)], "t string").select(F.substring(R.scrub(F.col("t")), 1, 36).alias("t")).collect()
    assert row[0]["t"].startswith("x" * 30 + " [RE") and row[1]["t"] is None and row[2]["t"] == ""


def test_project_keys(spark):
    urls = ["git@host.org:me/Repo.git", "https://host.org/me/repo", "ssh://git@host.org/me/repo.git"]
    assert {r["k"] for r in frame(spark, [(u,) for u in urls], "u string").select(T.project_key(F.col("u")).alias("k")).collect()} == {"host.org/me/repo"}


def test_transcript_edge_lines(spark):
    lines = [
        '{"type":"user","timestamp":"t1","cwd":"/a","message":{"content":"hello <system-reminder>x\\ny</system-reminder>"}}',
        "not json", "[1,2]", '{"type":"user","isMeta":true,"message":{"content":"meta"}}',
        '{"type":"assistant","timestamp":"t2","cwd":"/b","message":{"content":[{"type":"text","text":"a"},{"type":"tool_use","name":"Bash","input":{"command":"ls  -l"}},{"type":"text","text":"b"}]}}',
        '{"type":"ai-title","aiTitle":"gen"}', '{"type":"custom-title","customTitle":"mine"}', '{"type":"user","message":{"content":[{"type":"tool_result","is_error":true,"content":"bad"}]}}',
    ]
    df = frame(spark, [("s", i, x) for i, x in enumerate(lines)], "session_id string, rowid long, line string")
    parsed = TR.parse(df)
    assert [(r["role"], r["content"]) for r in TR.messages(parsed).orderBy("rowid").collect()] == [("user", "hello"), ("assistant", "a b")]
    s = TR.sessions(parsed).first()
    assert (s["cwd"], s["title"], s["first_ts"], s["last_ts"], s["messages"]) == ("/a", "mine", "t1", "t2", 2)
    assert {(r["role"], r["content"]) for r in TR.tools(parsed).collect()} == {("tool", "Bash: ls -l"), ("toolerr", "bad")}


OPS = "op_id string, machine_id string, machine_seq long, lamport long, class string, op string, project_key string, payload string, k long, seq long, verified boolean, entry string, bucket string"


def ops_rows(n=40):
    random.seed(9)
    return [(f"o{i}", f"m{i % 3}", i, random.randrange(12), "memory", random.choice(["put", "replace"]), "p", '{"k":"ä"}', i % 5, i, True, f"e{i % 11}", f"b{i % 2}") for i in range(n)]


def test_replay_ignores_order_and_repeats(spark):
    rows = ops_rows()
    once = sorted(map(tuple, K.replay(frame(spark, rows, OPS)).collect()))
    again = rows + rows[:10]
    random.shuffle(again)
    assert sorted(map(tuple, K.replay(O.first_delivery(frame(spark, again, OPS))).collect())) == once


def test_last_writer_uses_the_logical_clock(spark):
    rows = [("a", "m1", 1, 5, "x"), ("b", "m0", 9, 5, "y"), ("c", "m2", 2, 4, "z")]
    df = frame(spark, rows, "op_id string, machine_id string, machine_seq long, lamport long, v string").withColumn("k", F.lit(1))
    assert O.last_writer(df, ["k"], ["v"]).first()["v"] == "x"


def test_mac_and_tampering(spark):
    signed = K.signed(frame(spark, ops_rows(6), OPS), b"secret")
    assert K.verified(signed, b"secret").where("valid").count() == 6
    assert K.verified(signed, b"other").where("valid").count() == 0
    assert K.verified(signed.withColumn("lamport", F.col("lamport") + 1), b"secret").where("valid").count() == 0
    assert K.verified(signed.withColumn("mac", F.lit(None).cast("string")), b"secret").where("valid").count() == 0


def test_bundles_that_do_not_hold_are_refused(spark, tmp_path):
    ops, key = K.signed(frame(spark, ops_rows(), OPS), b"secret"), b"secret"
    path = str(tmp_path / "bundle")
    K.export_bundle(ops, key, path)
    back = K.import_bundle(spark, path, key)
    same = [c for c in back.columns if c != "payload"]
    assert sorted(back.select(same).collect()) == sorted(ops.select(same).collect())
    assert back.where("payload is not null").count() == ops.where("payload is not null").count()
    with pytest.raises(Exception, match="already exists"):
        K.export_bundle(ops, key, path)
    with pytest.raises(Exception, match="no bundle is written"):
        K.write_bundle(ops.withColumn("lamport", F.col("lamport") + 1), key).collect()
    with pytest.raises(Exception, match="isn't signed by this key"):
        K.import_bundle(spark, path, b"other")
    bundle = K.write_bundle(ops, key)
    with pytest.raises(Exception, match="damaged"):
        K.read_bundle(bundle.withColumn("body", F.concat("body", F.lit("x"))), key).collect()
    twice = bundle.withColumn("body", F.concat("body", F.lit("\n"), "body")).withColumn("n", F.col("n") * 2).withColumn("sha256", F.sha2("body", 256))
    with pytest.raises(Exception, match="repeats or misplaces"):
        K.read_bundle(twice, key).collect()
    with pytest.raises(Exception, match="repeats or misplaces"):
        K.read_bundle(bundle.withColumn("part", (F.col("part") + 1) % F.col("parts")), key).collect()
    bundle.union(bundle).write.parquet(str(tmp_path / "double"))
    with pytest.raises(ValueError, match="repeats a part"):
        K.import_bundle(spark, str(tmp_path / "double"), key)
    assert K.read_bundle(K.write_bundle(ops.limit(0), key), key).count() == 0


def test_chunks_wait_for_a_gap(spark):
    rows = [("s", 1, 5), ("s", 4, 9), ("s", 12, 14), ("t", 2, 3)]
    got = {r["session_id"]: (r["lines_held"], r["chunks_waiting"]) for r in O.contiguous_prefix(frame(spark, rows, "session_id string, from_line long, to_line long")).collect()}
    assert got == {"s": (9, 1), "t": (0, 1)}


def test_live_index_cursors(spark):
    lines = frame(spark, [(p, i, f"{p}{i}") for p, n in (("new", 3), ("grown", 4), ("cut", 2), ("same", 2)) for i in range(1, n + 1)], "path string, rowid long, line string")
    files = frame(spark, [("new", "1", 3, False), ("grown", "2", 4, True), ("cut", "2", 2, True), ("same", "1", 2, True)], "path string, stamp string, n_lines long, complete boolean")
    cursors = frame(spark, [("grown", "1", 2), ("cut", "1", 5), ("same", "1", 2)], "path string, stamp string, lines_indexed long")
    new, moved = L.advance(lines, files, cursors)
    assert {(r["path"], r["rowid"]) for r in new.collect()} == {("new", 1), ("new", 2), ("grown", 3), ("grown", 4), ("cut", 1), ("cut", 2)}
    assert {r["path"]: r["lines_indexed"] for r in moved.collect()} == {"new": 2, "grown": 4, "cut": 2, "same": 2}


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rows = [("a", t, i) for i, t in enumerate([0, 5, 10, 19, 20, 31])] + [("b", t, i) for i, t in enumerate([3, 4])]
    want = {("a", 10), ("a", 20), ("a", 31)}
    df = frame(spark, rows, "k string, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["k"], r["t"]) for r in L.act_at_most_every(df, "k", "ts", 10).where("acts").collect()}
    assert got == want
    src = str(tmp_path / "in")
    df.selectExpr("k", "s t").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, t long").parquet(src)
    q = L.act_at_most_every_stream(stream, 10).writeStream.format("memory").queryName("acts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["t"]) for r in spark.table("acts").where("acts").collect()} == want


def test_log_stream_is_idempotent(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    for part in (ops_rows(10), ops_rows(16)):
        frame(spark, part, OPS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame(spark, part, OPS).schema).parquet(src)
        L.run_log(spark, stream, log, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(log).count() == 16


def test_phrase_and_grep(spark):
    docs = frame(spark, [(1, "a b c a b"), (2, "b a"), (3, None)], "id long, t string")
    assert {(r["id"], r["n"]) for r in S.phrase(S.postings(docs, ["id"], "t"), ["id"], ["a", "b"]).collect()} == {(1, 2)}
    msg = frame(spark, [("s", i, "needle" if i == 3 else "x") for i in range(7)], "session_id string, rowid long, content string")
    assert [r["rowid"] for r in S.grep(msg, "Needle", 1, True).orderBy("rowid").collect()] == [2, 3, 4]


def test_porter_stems_and_query_parsing():
    from loomstone.functions.stem import folded, stem

    # Examples of the published algorithm.
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit generalization gener oscillators oscil adoption adopt probate probat controlling control rate rate cease ceas"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
    assert folded("Élan") == "elan"
    assert S.query_phrases('find a/b.py "x"') == [["find"], ["a", "b", "py"], ["x"]]
    assert S.is_code_token("do_it") and S.is_code_token("a.b") and S.is_code_token("camelCase") and not S.is_code_token("plain words")


def test_stemmed_search_finds_other_forms(spark):
    docs = frame(spark, [(1, "motoring about"), (2, "a motor"), (3, "nothing"), (4, None)], "id long, t string")
    assert {r["id"] for r in S.bm25(S.stemmed(docs, "t"), ["id"], "t", ["motor"]).collect()} == {1, 2}


def test_page_tokens():
    token = K.page_token(b"k", 17, 100)
    assert K.read_token(b"k", token, 99) == 17
    for bad in (token.replace("17", "18", 1), K.page_token(b"other", 17, 100)):
        with pytest.raises(ValueError, match="not issued"):
            K.read_token(b"k", bad, 99)
    with pytest.raises(ValueError, match="expired"):
        K.read_token(b"k", token, 101)


def test_later_removal_wins(spark):
    rows = [(1, "a", "put", 1), (1, "b", "remove", 2), (2, "c", "remove", 1), (2, "d", "put", 2)]
    df = frame(spark, rows, "k int, op_id string, op string, lamport long").withColumns({"machine_id": F.lit("m"), "machine_seq": F.col("lamport")})
    assert {(r["k"], r["op_id"]) for r in O.put_or_remove(df, ["k"], ["op_id"]).collect()} == {(2, "d")}


@pytest.mark.parametrize("size", [61, 35])
def test_drawing_passes_over_components_that_do_not_fit(spark, size):
    from types import SimpleNamespace

    from loomstone.plans.flows import draw_selection

    sizes = [size] * 60 + [2] * 30
    ids = [[1000 * k + j for j in range(n)] for k, n in enumerate(sizes)]
    edges = [(c[0], i, "x", 1.0) for c in ids for i in c[1:]]
    v = SimpleNamespace(beliefs=frame(spark, [(i,) for c in ids for i in c], "id long"), edges=frame(spark, edges, EDGE))
    got = sorted(r["component"] for r in draw_selection(v).collect())
    first = [0] if size <= 60 else []
    assert got == first + [1000 * (60 + k) for k in range(12 - len(first))]


def test_literal_scan_follows_only_where_no_row_has_all_terms(spark):
    from types import SimpleNamespace

    from loomstone.plans.retrieval import session_search

    rows = [("s1", 1, "p1", "xthe AND thtiony"), ("s1", 2, "p1", "the and"), ("s2", 1, "p2", "nothing")]
    schema = "session_id string, rowid long, project string, content string"
    found = lambda r: [tuple(x) for x in session_search(SimpleNamespace(msg=frame(spark, r, schema))).select("session_id", "rowid", F.col("rank").isNull()).collect()]
    assert found(rows) == [("s1", 1, True)]
    assert found([*rows, ("s3", 1, "p1", "thtion and the")]) == [("s3", 1, False)]


def test_deferred_operations_apply_once_what_they_wait_for_does(spark):
    from loomstone.operators.oplog import deferred

    ops = frame(spark, [("c", 4, 3), ("b", 3, 2), ("a", 2, 1), ("x", 9, 8), ("y", 8, 9), ("n", 10, None)], "op_id string, uid long, ref long")
    known = frame(spark, [(1,), (1,)], "uid long")
    assert sorted(r["op_id"] for r in deferred(ops, known).collect()) == ["n", "x", "y"]
    assert deferred(ops, known.where("uid = 0")).count() == 6


def test_replay_equals_a_scan_of_all_entries(spark):
    import random

    from loomstone.operators.signing import replay

    draw = random.Random(5)
    ops = [("b", i, "m", i, draw.choice([None, *range(6)]), draw.choice(["put", "replace"]), draw.choice(["one", "One", "two", "three", "four", "five"])) for i in range(80)]
    want: list[tuple] = []
    for _, _, _, _, k, op, entry in ops:
        at = next((i for i, (key, _) in enumerate(want) if k is not None and key == k), None)
        if op == "replace" and at is not None:
            want[at] = (k, entry)
        elif not any(e.lower() == entry.lower() for _, e in want):
            want.append((k, entry))
    got = replay(frame(spark, ops, "bucket string, lamport long, machine_id string, machine_seq long, k long, op string, entry string"))
    assert [r["entry"] for r in got.orderBy("place").collect()] == [e for _, e in want]


def test_digest_of_rows_ignores_order_and_counts_repeats(spark):
    import hashlib
    import json

    def naive(rows):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        level, n = {}, 0
        for r in rows:
            body = json.dumps(list(r), separators=(",", ":"), ensure_ascii=False)
            path = sha(f"{len(body.encode())}:{body}")
            level[path] = level.get(path, 0) + 1
            n += 1
        for digits in (5, 2, 0):
            up = {}
            for path, d in level.items():
                up.setdefault(path[:digits], []).append(f"{path}:{d}")
            level = {k: sha("\n".join(sorted(v))) for k, v in up.items()}
        return n, level.get("", sha(""))

    def run(rows, parts=1):
        return tuple(K.rows_digest(spark.createDataFrame(rows, "a string, b string").repartition(parts), ["a", "b"]).first())

    rows = [(f"x{i % 40}", None if i % 7 == 0 else "null" if i % 7 == 1 else "d\u00e9j\u00e0 \"v\"") for i in range(300)]
    assert run(rows) == run(rows[::-1], 4) == naive(rows)
    assert run([("a", "b")]) != run([("a", "b")] * 2) == naive([("a", "b")] * 2)
    assert run([("ab", "c")]) != run([("a", "bc")])
    assert run([("a", None)]) != run([("a", "null")])
    assert run([]) == naive([])


def test_header_probe_stays_in_its_prefix(spark):
    from loomstone.sources.transcripts import header_probe

    meta = lambda body: '{"type":"session_meta","payload":' + body + "}"
    head = meta('{"id":"a"}')
    files = {
        "found": ["junk", "", head, meta('{"id":"b"}')], "just": ["x" * (99 - len(head)), head], "over": ["x" * (100 - len(head)), head],
        "second": [meta('{"id":"","session_id":"c"}')], "number": [meta('{"id":5,"session_id":"c"}')], "zero": [meta('{"id":0,"session_id":"c"}')],
        "list": [meta("[1]"), head], "none": ['{"type":"other"}', "[]"], "cut": [head[:-1], meta('{"session_id":"d"}')], "empty": [meta('{"id":"","session_id":""}')],
    }
    rows = [(k, i, x) for k, v in files.items() for i, x in enumerate(v)] + [("null", 0, None)]
    got = dict(header_probe(spark.createDataFrame(rows, "session_id string, rowid long, line string"), 100).collect())
    assert {k: v for k, v in got.items() if v is not None} == {"found": "a", "just": "a", "second": "c", "zero": "c", "cut": "d"}
    assert set(got) == {*files, "null"}


def test_typed_queries_are_phrases_and_code_is_also_literal(spark):
    from loomstone.operators.search import typed

    texts = ["call load_file now", "file load", "reload_files", "Load the file", None, "", "load-file"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in typed(rows, ["k"], "t", ["load_file", "load file", "--", "Load"]).collect():
        got.setdefault(r["q"], {})[r["k"]] = r["tier"]
    assert got == {"load_file": {0: 0, 6: 0, 2: 1}, "load file": {0: 0, 1: 0, 3: 0, 6: 0}, "Load": {0: 0, 1: 0, 3: 0, 6: 0}}
    assert typed(rows, ["k"], "t", []).count() == 0


#: Letters beyond ASCII beside words, and letters that fold to ASCII ones: Java's regular expressions differ from SQL's there.
ODD_MESSAGES = ["éque la vie", "que laé", "xque la", "über und deré", "ou oui", "é ou", "ſtop. now", "stop, now", "i ſaid", "as I SAID so", "you dıdnt read", "DON'T DO THAT", "éno, no", "no, that", "", None, "UND DER", "der und der", "aK the a", "undo thiſ"]


@pytest.fixture
def messages(spark, tmp_path):
    """Views over a folder with odd messages, and their SQL."""
    import duckdb

    from loomstone.plans import ORACLE, QUERIES

    rows = [(i // 5, i % 5, "user" if i % 9 else "system", t) for i, t in enumerate(ODD_MESSAGES * 2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))

    def both(name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        got, res = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLE[name])
        names = [d[0] for d in res.description]
        return sorted(map(tuple, got.select(*names).collect())), sorted(res.fetchall())

    return both


def test_corrections_among_letters_beyond_ascii(messages):
    got, want = messages("mine_corrections")
    assert got == want and {r[2:] for r in want} == {(False, False), (False, True), (True, False)}


def test_daily_corrections_among_letters_beyond_ascii(messages):
    got, want = messages("mine_daily")
    assert got == want


def test_zscore_among_letters_beyond_ascii(messages):
    got, want = messages("mine_zscore")
    assert got == want


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_jaccard_candidates_are_not_shuffled(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, "x" if i % 3 else "y", random.sample(words, 10)) for i in range(900)]
    rows += [(900 + i, "x", words[:8]) for i in range(4)] + [(950, None, words[:8]), (951, None, words[:8]), (952, "x", [])]
    want = {(a, b, round(len(s & t) / len(s | t), 6)) for a, x, p in rows for b, y, q in rows if a < b and x == y and x and p and q for s, t in [(set(p), set(q))] if len(s & t) / len(s | t) >= 0.5}
    before = shuffled(spark)
    got = M.jaccard_pairs(frame(spark, rows, "id long, block string, toks array<string>"), 0.5).collect()
    assert sorted((r["a"], r["b"], round(r["score"], 6)) for r in got) == sorted(want) and len(want) > 15
    # 33,379 rows where pairs that share a token of a prefix are shuffled.
    assert (n := shuffled(spark) - before) < 15_000, n


def test_dream_candidates_look_no_further_than_needed(spark, tmp_path, monkeypatch):
    from loomstone.plans import QUERIES

    asked, real = [], M.jaccard_pairs
    monkeypatch.setattr(M, "jaccard_pairs", lambda rows, threshold: asked.append(threshold) or real(rows, threshold))
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i * 5, text if i < n else f"alpha beta gamma delta epsilon zeta own{i}", "en") for n in (8,) for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["a"], r["b"], r["score"]) for r in QUERIES["dream_candidates"](spark, str(tmp_path)).collect()]
    # Every sum of two ids is a multiple of five, so all pairs are reviewed, and all thresholds are tried.
    assert got == [] and asked == [0.9, 0.65, 0.4]
    asked.clear()
    docs = [(i * 10 + (i % 2) * 6, text if i < 8 else f"alpha beta gamma delta epsilon zeta own{i}", "en") for i in range(10)]
    docs = [(d if d % 5 == 0 else d // 5 * 5 + 1, t, x) for d, t, x in docs] + [(1000 + 10 * i + 2, text, "en") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "more/documents.parquet"))
    got = [(r["a"], r["b"], r["score"]) for r in QUERIES["dream_candidates"](spark, str(tmp_path / "more")).collect()]
    same = [d for d, t, _ in docs if t == text]
    kind = lambda d: {0: "user", 1: "user-model"}.get(d % 5, "project:en")
    want = sorted((a, b, 1.0) for a in same for b in same if a < b and kind(a) == kind(b) and (a + b) % 5)[:12]
    assert got == want and len(want) == 12 and asked == [0.9]


def resolved(rows):
    """Brute force of the resolution: rows of (id, block, tokens)."""
    pairs = [(max(len(s & t) / len(s), len(s & t) / len(t)), a, b) for a, x, p in rows for b, y, q in rows if a < b and x == y and x and p and q for s, t in [(set(p), set(q))]]
    gone, out = set(), set()
    for score, a, b in sorted((p for p in pairs if p[0] >= 0.6), key=lambda p: (-p[0], p[1], p[2])):
        if a not in gone and b not in gone:
            action = "merge" if score >= 0.95 else "supersede_b" if score >= 0.8 else "keep"
            out.add((a, b, action))
            gone |= {b} if action != "keep" else set()
    return out


def test_dream_resolution_shuffles_rows_and_no_candidates(spark, tmp_path):
    from loomstone.plans import QUERIES

    random.seed(8)
    words = [f"w{i:02}" for i in range(40)]
    docs = [(i, " ".join(random.sample(words, random.choice((1, 4, 9, 10, 11)))), "en") for i in range(500)]
    docs += [(500 + i, docs[i % 40][1] if i % 3 else " ".join(["own", *docs[i][1].split()[1:]]), None if i % 7 == 0 else "en") for i in range(100)] + [(600, "", "en"), (601, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    kind = lambda d, lang: {0: "user", 1: "user-model"}.get(d % 5, lang and f"project:{lang}")
    want = resolved([(d, kind(d, lang), (t or "").split()) for d, t, lang in docs if d % 10 < 7])
    before = shuffled(spark)
    got = [tuple(r) for r in QUERIES["dream_resolution"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {x for *_, x in want} == {"merge", "supersede_b", "keep"}
    # 16,957 rows where pairs that share a token of a prefix are shuffled.
    assert (n := shuffled(spark) - before) < 5_000, n


def test_losers_in_rounds_and_in_one_fold(spark):
    random.seed(9)
    pairs = sorted({tuple(sorted(random.sample(range(60), 2))) for _ in range(300)} | {(i, i + 1) for i in range(100, 112)})
    pairs = [(a, b, random.choice((0.8, 0.9, 1.0)) if a < 100 else 1.0) for a, b in pairs]
    gone, want = set(), []
    for score, a, b in sorted((-score, a, b) for a, b, score in pairs):
        if a not in gone and b not in gone:
            gone.add(b)
            want.append((a, b, -score))
    df = frame(spark, pairs, "a long, b long, score double")
    for most in (0, 40, 1000):
        assert sorted(tuple(r) for r in M.losers(df, most).select("a", "b", "score").collect()) == sorted(want)


def test_clusters_join_only_rows_outside_the_large_component(spark, monkeypatch):
    random.seed(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "x" if i % 3 else "y", random.sample(words, 8)) for i in range(200)]
    rows += [(200 + i, "x", [f"u{i // 3}a", f"u{i // 3}b", f"own{i}", f"o{i}"]) for i in range(12)] + [(300, "x", []), (301, "y", ["lone"])]
    rows += [(310, "x", [f"p{i}" for i in range(10)]), (311, "x", [f"p{i}" for i in range(7, 17)]), (312, "x", [f"p{i}" for i in range(15, 25)])]
    df = frame(spark, rows, "id long, block string, toks array<string>")
    sizes, real = [], M.covering_pairs
    monkeypatch.setattr(M, "covering_pairs", lambda left, right, threshold: sizes.append(min(left.count(), right.count())) or real(left, right, threshold))
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x, p in rows:
        for b, y, q in rows:
            if a < b and x == y and p and q and len({*p} & {*q}) / min(len(p), len(q)) >= 0.3:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    got = dict(G.components(df, M.cluster_links(df, 0.3)).collect())
    assert got == {i: find(i) for i, *_ in rows}
    assert len(sizes) == 2 and max(sizes) < 150 < len(rows)
