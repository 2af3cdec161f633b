import json

from chunkloom.config import ChunkConfig
from chunkloom.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    made = [{"event_id": f"{i:032x}", "source_id": "s", "file_path": f"f{i}.py", "language": "python", "normalized_content": f"import os\n\ndef f{i}():\n    return {i}\n" * 5,
             "entities": [{"entity_type": "function", "name": f"f{i}", "start_line": 3, "end_line": 4, "content": "x"}], "metadata": {}, "timestamp": None} for i in range(6)]
    lines = [json.dumps(e) for e in [*made, made[0], made[3] | {"event_id": made[3]["event_id"].upper()}]] + ["broken", "{}"]
    (source / "one.txt").write_text("\n".join(lines[:5]) + "\n")
    (source / "two.txt").write_text("\n".join(lines[5:]) + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    query = events.run(spark, stream, lambda df, epoch: out.extend(df.collect()), str(tmp_path / "cp"), dead_letters=str(tmp_path / "dead"), config=ChunkConfig(20, 10))
    query.awaitTermination()
    for other in spark.streams.active:
        other.awaitTermination()
    batch = events.outbound(events.event_chunks(spark.createDataFrame([(x,) for x in lines[:6]], "value string").transform(
        lambda df: events.decode_events(df).filter("event IS NOT NULL").select("event.*")), ChunkConfig(20, 10))).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch)) and len(out) > 6
    assert json.loads(out[0].value)["total_chunks"] >= 1 and {r.partition for r in out} <= set(range(6))
    assert sorted(r.raw for r in spark.read.json(str(tmp_path / "dead")).collect()) == ["broken", "{}"]


def test_stream_query_equals_batch_query(spark, data):
    from chunkloom.plans import chunking

    stream, batch = (sorted(map(tuple, q(spark, data).collect())) for q in (chunking.stream_event_chunks, chunking.batch_event_chunks))
    assert stream == batch and stream


def test_events_without_an_identifier_all_pass(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    ids = [None, "", "  ", None, "", "  ", "00000000000000000000000000000001", "{00000000-0000-0000-0000-000000000001}"]
    lines = [json.dumps({"event_id": e, "source_id": "s", "file_path": f"f{i}.py", "language": "python", "normalized_content": f"def f{i}():\n    return {i}\n" * 9, "entities": [],
                         "metadata": {}, "timestamp": None}) for i, e in enumerate(ids)]
    lines.append(lines[1])
    (source / "one.txt").write_text("\n".join(lines[:4]) + "\n")
    (source / "two.txt").write_text("\n".join([*lines[4:], '{"source_id": "s"}']) + "\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    query = events.run(spark, stream, lambda df, epoch: out.extend(df.collect()), str(tmp_path / "cp"), config=ChunkConfig(20, 10))
    query.awaitTermination()
    made = [json.loads(r.value) for r in out]
    each = [sum(m["file_path"] == f"f{i}.py" for m in made) for i in range(8)]
    n = each[0]
    assert n > 1 and each[:6] == [n, 2 * n, n, n, n, n] and sorted(each[6:]) == [0, n] and {m["total_chunks"] for m in made} == {n}
    assert {m.get("event_id") for m in made if m["file_path"] in ("f0.py", "f1.py", "f2.py")} == {None, "", "  "}
    assert len({m["chunk_id"] for m in made}) in (7 * n, 8 * n)  # equal messages of one trigger may share their ids
    assert sum(p["numInputRows"] for p in query.recentProgress) == len(lines) + 1  # the source is read once
