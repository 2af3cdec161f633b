import json
import os

from pyspark.sql import functions as F

from chunkloom.config import PROFILES, BatchConfig, ChunkConfig, ServiceConfig, profiles
from chunkloom.functions.text import byte_prefix, is_blank, lines, merge_short, split_sentences, trimmed
from chunkloom.functions.tokens import BpeCounter, counter, count_tokens, tile_tokens
from chunkloom.operators import breaker, chunk, enrich, jobs, ring, route, symbols
from chunkloom.sources import files, sinks

ITEM = "id string, source_id string, source_kind string, content_type string, content string, metadata string, item string, carried_source_id int"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ITEM)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, lines(F.lit("a\r\nb\n\n"))) == ["a", "b", ""] and one(spark, lines(F.lit(""))) == []
    assert one(spark, trimmed(F.lit("  x "))) == "x" and one(spark, is_blank(F.lit("　")))
    assert one(spark, byte_prefix(F.lit("éé版x"), 6)) == "éé" and one(spark, byte_prefix(F.lit("ab"), 6)) == "ab" and one(spark, byte_prefix(F.lit("🙂"), 3)) == ""
    assert one(spark, split_sentences(F.lit("Hi. There! 3.14 a?\nb"))) == ["Hi.", "There!", "3.14 a?", "b"]
    assert one(spark, merge_short(F.array(*map(F.lit, ["a", "bb", "cccc", "d"])), 4)) == ["a bb", "cccc d"]
    assert one(spark, merge_short(F.array(F.lit("a")), 4)) == ["a"] and one(spark, count_tokens(F.lit(None).cast("string"))) is None
    text = "Hi, x_1 é  \n ok "
    assert one(spark, count_tokens(F.lit(text))) == counter().count(text) and one(spark, tile_tokens(F.lit(text))) == counter().encode(text)


def test_bpe_counter():
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        return
    c = counter(f"bpe:{path}")
    assert isinstance(c, BpeCounter) and c.decode(c.encode("Hello, wörld")) == "Hello, wörld" and c.count("") == 0
    assert c.decode(c.encode("🙂")[:1]) == ""  # a part of a character
    from chunkloom.operators.segment import STRATEGIES, Item, chunked

    for name in STRATEGIES:
        made = chunked(Item("# T\n\nOne sentence here. And another, longer one!\n\nLast? " * 5), name, ChunkConfig(20, 5), c)
        assert made and [p.index for p in made] == list(range(len(made)))


def test_routes(spark):
    rows = [("1", "s", "code_repo", "text/plain", "x", "{}"), ("2", "s", "document", "text/plain", "x", "{}"), ("3", "s", "chat", "application/json", "x", "{}"), ("4", "s", "ticketing", "text/markdown", "x", "{}"),
            ("5", "s", "web", "text/csv", "x", "{}"), ("6", "s", "web", "text/code:rust", "x", "{}"), ("7", "s", "other", "application/json+chat", "x", "{}"), ("8", "s", "email", "", "x", "{}"), ("9", "s", "new", None, "x", "{}")]
    df = items(spark, rows).select("id", route.strategy(F.col("content_type"), F.col("source_kind")).alias("c"))
    assert [r.c for r in df.orderBy("id").collect()] == ["code", "document", "chat", "document", "table", "code", "chat", "chat", "sentence"]
    assert route.named("Smart") == "agentic" and route.named("nope") is None and route.strategies(spark).count() == 9
    langs = spark.createDataFrame([("main.rs",), ("app.PY",), ("index.tsx",), ("unknown.xyz",), ("go",), (None,)], "p string").select(route.detect_language(F.col("p")).alias("l"))
    assert [r.l for r in langs.collect()] == ["rust", "python", "typescript", None, "go", None]
    meta = spark.createDataFrame([('{"path": "a/b", "language": 3}',), ("no json",), (None,)], "m string").select(route.path(F.col("m")).alias("p"), route.metadata_string(F.col("m"), "language").alias("l"))
    assert [tuple(r) for r in meta.collect()] == [("a/b", None), (None, None), (None, None)]


def test_pieces_on_odd_rows(spark):
    long = "word " * 50_000
    rows = [("a", "s", "other", "text/plain", "One. Two. Three.", "{}"), ("a", "s", "other", "text/plain", "One. Two. Three.", "{}"), ("b", "s", "web", "text/html", "", None), ("c", None, "chat", None, None, "bad"),
            (None, "s", "wiki", "text/markdown", "# T\nx", "{}"), ("d", "s", "code_repo", "text/plain", long, '{"language": "python", "path": "p.py"}')]
    got = chunk.pieces(items(spark, rows)).collect()
    assert {r.item for r in got} == {"a", None, "d"} and sum(r.item == "a" for r in got) == 2 and all(r.error is None for r in got)
    assert {(r.language, r.path) for r in got if r.item == "d"} == {("python", "p.py")}
    rows = chunk.chunks(items(spark, rows)).collect()
    assert len({r.id for r in rows}) == len(rows) - 1 and rows[0].source_kind
    assert chunk.chunks(items(spark, [])).count() == 0 and chunk.pieces(items(spark, [("z", "s", "web", "x", "a b", "{}")]), strategy="markdown").first().strategy == "document"


def test_jvm_variants_agree(spark):
    rows = [(str(i), "s", "other", "text/plain", t, "{}") for i, t in enumerate(["Hi. Yes. A longer one here, and more! Ok?", "x", "é. é! " * 30, "a b c d e f g " * 40, "End.\nNext one. Last"])]
    df = items(spark, rows)
    folds = {(r.item, r.chunk_index): (r.content, r.token_count) for r in chunk.sentence_folds(df, 9).collect()}
    packed = {(r.item, r.chunk_index): (r.content, r.token_count) for r in chunk.pieces(df, ChunkConfig(9), "sentence").collect()}
    assert folds == packed
    jvm = sorted((r.item, r.chunk_index, r.content, r.start_index, r.end_index) for r in chunk.token_windows(df, 7, 3).collect())
    py = sorted((r.item, r.chunk_index, r.content, r.start_index, r.end_index) for r in chunk.pieces(df, ChunkConfig(7, 3), "token").collect())
    assert jvm == py


def test_batch_summary_and_errors(spark, monkeypatch):
    df = items(spark, [("1", "s", "other", "text/plain", "One. Two.", "{}"), ("2", "s", "web", "", "", "{}")])
    made, summary = chunk.batch(df)
    assert made.count() == 1 and summary.first().asDict() == {"total_items": 2, "processed": 2, "failed": 0, "total_chunks": 1}
    assert chunk.batch_errors(df).count() == 0
    assert [len(x) for x in chunk.streamed(items(spark, [(str(i), "s", "other", "t", "One.", "{}") for i in range(25)]), 10)] == [10, 10, 5]
    assert chunk.batch(items(spark, []))[1].first().total_chunks == 0
    large = chunk.split_large(items(spark, [("1", "s", "o", "t", "one\n\ntwo\n\nthree\n\nfour", "{}")]), 15).collect()
    assert [(r.piece_no, r.start_offset) for r in large] == [(0, 0), (1, 10)]


def test_symbols(spark):
    rust = "pub struct S {\n}\nimpl<T> X for S {}\nimpl Clone for S {\n    pub fn new() -> S {\n    }\n    fn after() {}\n}\npub(crate) fn no() {}\npub const fn c() {}\nenum E<T> {}\n"
    assert [(s[0], s[1], s[3]) for s in symbols.extract(rust, "rust")] == [("S", "struct", None), ("new", "method", "S"), ("after", "function", None), ("c", "function", None), ("E", "enum", None)]
    py = "class A(B):\n    def m(self):\n        pass\n    async def n(self): pass\ndef f():\n    pass\n"
    assert [(s[0], s[1], s[2], s[3]) for s in symbols.extract(py, "python")] == [("A", "class", 0, None), ("m", "method", 1, "A"), ("n", "method", 3, "A"), ("f", "function", 4, None)]
    js = "export class W {\n  m() {}\n}\nexport async function go<T>() {}\nconst add = (a) => a;\nconst x = 1;\nexport interface I<T> {}\ntype T2 = string;\n"
    assert [(s[0], s[1]) for s in symbols.extract(js, "typescript")] == [("W", "class"), ("go", "function"), ("add", "function"), ("I", "interface"), ("T2", "interface")]
    assert symbols.extract("fn a() -> b {}", None)[0][0] == "a" and symbols.extract("def a(self): x", "go")[0][0] == "a" and symbols.extract("nothing", None) == []
    df = spark.createDataFrame([("a.rs", rust, "rust"), ("b.py", py, "python"), ("c.py", None, "python"), ("d.js", "", None)], "path string, content string, language string")
    found = symbols.symbols(df)
    assert {r.path for r in symbols.find(found, "new").collect()} == {"a.rs"} and symbols.of_file(found, "b.py").count() == 4
    assert [r.path for r in symbols.locations(found).collect() if r.name == "f"] == ["b.py"] and symbols.by_path(found).count() == 2
    assert symbols.imports("use a::b::{c, d};\nuse x::*;\n", "rust") == [("a::b", ["c", "d"], False), ("x", [], True)]
    assert symbols.imports("from a import b, c\nimport os", "python") == [("a", ["b", "c"], False), ("os", [], False)]


def test_enrichment(spark):
    def prefix(shown=enrich.Prefix(), **given):
        base = {"file_path": "src/a.rs", "repository": None, "branch": None, "language": "rust", "scope": "", "definitions": [], "dependencies": [], "documentation": None, "metadata": {}} | given
        df = spark.createDataFrame([("body", base)], f"content string, context struct<{enrich.CONTEXT.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map').replace(', ', ',')}>")
        return enrich.enriched(df, shown).first()

    got = prefix(scope="mod", repository="r", definitions=[{"name": "f", "entity_type": "function", "signature": None}, {"name": "g", "entity_type": "function", "signature": "fn g()"}], dependencies=["x", "y"], documentation="d" * 150)
    assert got.prefix == "# File: src/a.rs\n# Language: rust\n# Repository: r\n# Scope: mod\n# Defines: function f, fn g()\n# Dependencies: x, y\n# Doc: " + "d" * 97 + "..."
    assert got.enriched_content == got.prefix + "\n---\nbody"
    assert prefix(dependencies=["d" * 30] * 9).prefix.endswith("# Dependencies: " + ", ".join(["d" * 30] * 5) + " ...")
    assert prefix(repository="r" * 600).prefix == "# File: src/a.rs\n# Language: rust" and prefix(file_path="é" * 400).prefix == "# File: " + "é" * 246
    bare = prefix(enrich.Prefix(file_path=False, scope=False, definitions=False, dependencies=False))
    assert bare.prefix == "" and bare.enriched_content == "body"
    contexts = spark.createDataFrame([("p", {"file_path": "p", "language": "go"})], "path string, context struct<file_path:string,repository:string,branch:string,language:string,scope:string,definitions:array<struct<name:string,entity_type:string,signature:string>>,dependencies:array<string>,documentation:string,metadata:map<string,string>>")
    rows = enrich.enriched_by_file(spark.createDataFrame([("p", "a"), ("q", "b")], "path string, content string"), contexts).collect()
    assert {r.content: r.enriched_content for r in rows} == {"a": "# File: p\n# Language: go\n---\na", "b": "b"}


def test_ring(spark):
    import bisect

    points = sorted((r.h, r.partition) for r in ring.ring(spark, 6).collect())
    keys = spark.createDataFrame([(f"key-{i}", i) for i in range(1000)], "key string, n int")
    hashed = keys.select("key", ring.place(F.col("key")).alias("h")).collect()
    want = {r.key: points[bisect.bisect_left(points, (r.h, -1)) % len(points)][1] for r in hashed}
    got = {r.key: r.partition for r in ring.assigned(keys, 6).collect()}
    assert got == want and all(sum(v == p for v in got.values()) > 50 for p in range(6))
    row = ring.stats(ring.ring(spark, 6), 6).first()
    assert row.total_ring_entries == 900 and row.variance == 0 and {r.partition for r in ring.assigned(keys, 0).collect()} == {0}


def test_breaker(spark):
    now = [0.0]
    b = breaker.Breaker(clock=lambda: now[0], jitter=lambda: 1.0)
    for _ in range(5):
        b.success(), b.failure()
    assert b.state == "open" and not b.allow() and b.backoff() == 60
    now[0] = 30
    assert b.allow() and b.state == "half_open"
    b.failure()
    assert b.state == "open" and not b.allow()
    now[0] = 90
    assert b.allow()
    for _ in range(3):
        b.success()
    assert b.stats() == {"state": "closed", "failures": 0, "successes": 8, "retry_count": 0}
    try:
        breaker.Breaker(breaker.BreakerConfig(failure_threshold=1), clock=lambda: 0).call(lambda: 1 / 0)
    except ZeroDivisionError:
        pass
    rows = [("a", f"2024-01-01 00:00:{i:02d}", i, i >= 5) for i in range(8)] + [("b", "2024-01-01 00:00:00", 1, True), ("c", None, 1, True)]
    df = spark.createDataFrame(rows, "service string, ts string, seq bigint, ok boolean")
    got = breaker.replayed(df).orderBy("service", "seq").collect()
    assert [r.state for r in got] == ["closed"] * 4 + ["open"] * 4 + ["closed"] and [r.allowed for r in got] == [True] * 5 + [False] * 3 + [True]


def test_config(tmp_path, spark):
    assert ServiceConfig.from_env({"CHUNK_SIZE": "9", "CHUNK_OVERLAP": "x"}).default_chunk_size == 9 and ServiceConfig.from_env({"CHUNK_OVERLAP": "x"}).default_chunk_overlap == 50
    (tmp_path / "c.toml").write_text("[chunking]\ndefault_chunk_size = 7\nactive_profile = 'small'\n")
    assert ServiceConfig.from_toml(str(tmp_path / "c.toml")).default_chunk_size == 7
    assert profiles(spark, "small").filter("active").first().name == "small" and len(PROFILES) == 4
    assert ChunkConfig.with_size(9).with_overlap(2).with_language("go") == ChunkConfig(9, 2, language="go") and BatchConfig().max_content_size == 10 * 1024 * 1024


def test_jobs(spark):
    sent = []
    service = jobs.Service(spark, ServiceConfig(), [lambda made: sent.append(made.count()), lambda made: 1 / 0])
    assert service.submit(items(spark, []))["accepted"] is False
    answer = service.submit(items(spark, [("1", "s", "other", "text/plain", "One. Two.", "{}")]))
    assert service.status(answer["job_id"])["status"] == "completed" and sent == [1] and service.status("none") is None
    assert service.set_active_profile("small") and not service.set_active_profile("no") and service.active_profile() == {"name": "small", "chunk_size": 256, "chunk_overlap": 25}
    assert service.health()["status"] == "healthy" and service.strategies().count() == 9
    assert {r.status: r.n for r in jobs.counts(service.store.table(spark)).collect()} == {"completed": 1}
    assert service.store.cleanup(3600) == 0 and service.store.cleanup(-1) == 1
    table = spark.createDataFrame([("a", "completed", "2024-01-01 00:00:00"), ("b", "failed", "2024-01-01 02:30:00"), ("c", "running", None)], "job_id string, status string, completed_at string")
    assert {r.job_id for r in jobs.kept(table.withColumn("completed_at", F.col("completed_at").cast("timestamp")), F.lit("2024-01-01 03:00:00").cast("timestamp")).collect()} == {"b", "c"}


def test_sinks(spark):
    made = chunk.chunks(items(spark, [(str(i), "s", "other", "text/plain", "One.", "{}") for i in range(120)])).coalesce(1)

    def post(url, body, timeout):
        if "embed" in url:
            if body["chunks"][0]["id"] and len(body["chunks"]) < 50:
                raise OSError("down")
            return {"embedded_count": len(body["chunks"])}
        assert body["extract_entities"] and body["chunks"][0]["source_type"] == "unknown"
        return {"chunks_processed": len(body["chunks"]), "entities_created": 1, "errors": ["e"]}

    assert sinks.EmbeddingSink("http://x", post=post)(made) == 100  # the last batch fails, the others count
    assert sinks.GraphSink("http://x", post=post)(made) == {"chunks_processed": 120, "entities_created": 3, "relationships_created": 0, "n_errors": 3, "errors": ["e"] * 3}
    assert sinks.GraphSink.disabled()(made)["chunks_processed"] == 0 and not sinks.GraphSink.disabled().healthy()
    assert sinks.GraphSink("http://127.0.0.1:9").healthy() is False
    assert sinks.EmbeddingSink("http://x", post=post)(made.filter("false")) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / "src" / "b.xyz").write_text("text")
    got = {r.content_type: json.loads(r.metadata) for r in files.read_files(spark, str(tmp_path), "s").collect()}
    assert set(got) == {"text/code:python", "text/code:text"} and got["text/code:python"]["path"].endswith("a.py") and got["text/code:text"]["language"] is None
    bodies = spark.createDataFrame([(json.dumps({"items": [{"id": "1", "source_id": "s", "source_kind": "web", "content_type": "t", "content": "c"}, {"id": None}]}),), ("broken",), (None,)], "value string")
    assert [(r.id, r.metadata) for r in files.items_from_json(bodies).collect()] == [("1", "{}")]
    assert files.kafka_source_options("h")["subscribe"] == "code.normalized" and files.kafka_sink_options("h")["kafka.acks"] == "all"
    try:
        files.RabbitClient("")
        raise AssertionError
    except ValueError:
        pass


def test_connectors(spark):
    from chunkloom.sources import connectors as c

    issue = spark.createDataFrame([("K-1", "T", "Open", None, "b", "a", "u", "2024-01-01 00:00:00", [("x", "y")])],
                                  "key string, title string, state string, priority string, body string, author string, url string, created_at string, comments array<struct<author:string,body:string>>")
    made = c.issues(issue, "s")
    assert made.first().content == "Title: T\nStatus: Open\n\nDescription:\nb\n\nComments:\n- x: y"
    assert [r.meta_type for r in chunk.pieces(made).orderBy("chunk_index").collect()] == ["description", "comments"]
    assert c.issues(issue, "s").first().id == made.first().id
    pr = spark.createDataFrame([(7, "T", "b", "open", "a", "u", None, [("x", "OK", "y")])], "number int, title string, body string, state string, author string, url string, created_at string, reviews array<struct<author:string,state:string,body:string>>")
    assert c.pull_requests(pr, "s").first().content == "# PR #7: T\n\n## Description\nb\n\n## Reviews\n**x** (OK): y"
    thread = spark.createDataFrame([("c", "1704441906.5", [("a", "hi", "1704441906.5")]), (None, None, [])], "channel string, thread_ts string, messages array<struct<user:string,text:string,ts:string>>")
    rows = c.threads(thread, "s").collect()
    assert str(rows[0].created_at) == "2024-01-05 08:05:06.500000" and rows[1].created_at is None and chunk.pieces(c.threads(thread, F.lit("s"))).first().content == "a: hi"
    code = c.code_files(spark.createDataFrame([("a/b.rs", "fn x() {}", "1")], "path string, content string, sha string"), "s", "o/r", "main").first()
    assert code.content_type == "text/code:rust" and json.loads(code.metadata)["repo"] == "o/r"
    page = spark.createDataFrame([("k", "T", "# x", "u", None)], "key string, title string, body string, url string, created_at string")
    assert c.pages(page, "s").first().source_kind == "wiki"
    mail = spark.createDataFrame([("k", "S", None, [("a", "b"), ("c", "d")])], "key string, subject string, created_at string, mails array<struct<author:string,body:string>>")
    assert c.mails(mail, "s").first().content == "a: b\n\nc: d"


def test_sql_functions(spark):
    from chunkloom.functions.sql import register

    register(spark)
    spark.createDataFrame([(1, "One two. Three four. Five."), (2, ""), (3, None)], "id int, content string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT t.id, c.content FROM texts t, LATERAL chunk_sentence(t.content, 3, 0) c ORDER BY id, chunk_index").collect()
    assert [(r.id, r.content) for r in got] == [(1, "One two. "), (1, "Three four. "), (1, "Five.")] or [(r.id, r.content) for r in got][0][0] == 1
    assert [r.n for r in spark.sql("SELECT count_tokens(content) AS n FROM texts ORDER BY id").collect()] == [8, 0, None]
    assert spark.sql("SELECT detect_language('a.PY') AS l, count_tokens('a b') AS n").first().l == "python"
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} >= {"texts"}


def test_dates_with_an_offset_only(spark):
    from chunkloom.operators.chunk import rfc3339

    texts = ["2024-01-31T09:05:07Z", "2024-01-31T09:05:07.25+02:00", "2024-01-31 09:05:07", "2024-01-31", "1706691907", "", None, "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(rfc3339(F.col("t"))).alias("us")).collect()
    assert [r.us for r in got] == [1706691907000000, 1706684707250000, None, None, None, None, None, None]
