"""WARC round trip, sharding table, chat collapse, queries against their SQL, and the pipeline."""

import gzip
import hashlib

import pytest
from helpers import SMALL, table

from tarnwick import scratch
from tarnwick.llm import chat, queries, sharding, warc


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert table(queries.queries()[name](spark, SMALL).toPandas()) == table(duck.sql(queries.oracle_sql()[name]).df())


def pages(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "https://a.org/1?q=1#f", big), (2, "http://b.org", big), (2, "http://b.org", big), (3, None, None), (4, "bad url\r\nX: y", "small"), (5, "https://c.org/", "small"), (None, "https://d.org/", big), (6, "https://e.org/", other), (7, "https://e.org/", other[:-1]), (8, "https://f.org/", "WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, response string").repartition(3)


@pytest.mark.parametrize("file_bytes", [500, 1 << 24])
def test_warc_round_trip(spark, file_bytes):
    folder = scratch.new_path(spark, "warc")
    assert warc.write_archives(spark, pages(spark), folder, file_bytes=file_bytes).agg({"n_records": "sum"}).first()[0] == 30
    captures = warc.assemble(warc.read_records(spark, folder))
    found = sorted((tuple(r) for r in warc.resolve(captures).collect()), key=str)
    held = {}
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    for page, body in rows:
        if len(body) >= 1000 and page is not None:
            held[body] = max(page, held.get(body, page))
    wanted = []
    for page, body in rows:
        again = body in held and page != held[body]
        wanted.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", held[body] if again else None))
    assert found == sorted(wanted, key=str)
    one = captures.where("response.payload_bytes = 5 and response.target_uri like 'https://c%'").first()
    assert one["request"]["head"].startswith("GET / HTTP/1.1\r\nHost: c.org") and bytes(one["response"]["payload"]) == b"small"


def test_resolving_shuffles_no_payload(spark, monkeypatch):
    folder, plans, table = scratch.new_path(spark, "warc"), {}, scratch.table
    warc.write_archives(spark, pages(spark), folder)
    captures = warc.assemble(warc.read_records(spark, folder))

    def kept(session, df, name, *rest):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return table(session, df, name, *rest)

    monkeypatch.setattr(scratch, "table", kept)
    assert warc.resolve(captures).count() == 10
    assert "metadata_payload" in plans["captures"] and "response_payload_digest" in plans["captures"]
    assert "response_payload#" not in plans["captures"] and "response_head" not in plans["captures"]


def test_plain_and_joined_archives_parse():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(record * 2)] == [b"abc", b"abc"]
    assert [b for _, b in warc.parse(gzip.compress(record) + gzip.compress(record * 2))] == [b"abc"] * 3


def test_no_pages(spark):
    folder = scratch.new_path(spark, "warc")
    assert warc.write_archives(spark, pages(spark).limit(0), folder).count() == 0
    assert warc.resolve(warc.assemble(warc.read_records(spark, folder))).count() == 0


def test_queries_of_empty_tables(spark, tmp_path):
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {name: query(spark, str(tmp_path)).count() for name, query in queries.queries().items()} == dict.fromkeys(queries.queries(), 0)


@pytest.mark.parametrize(("shards", "size"), [(["a"], 7), (["a", "b", "c"], 13), ([f"s{n}" for n in range(20)], 251)])
def test_lookup_table(shards, size):
    found = sharding.lookup_table(shards, size)
    counts = [found.count(n) for n in range(len(shards))]
    assert len(found) == size and max(counts) - min(counts) <= 1
    preference = []
    for s in shards:
        at, step = (int(hashlib.md5(f"{s}|{k}".encode()).hexdigest()[:15], 16) for k in ("offset", "step"))
        preference.append([(at % size + j * (step % (size - 1) + 1)) % size for j in range(size)])
    slow: dict[int, int] = {}
    while len(slow) < size:
        for n, order in enumerate(preference):
            free = next((s for s in order if s not in slow), None)
            if free is not None:
                slow[free] = n
    assert found == [slow[s] for s in range(size)]


def test_losing_a_shard_moves_few_slots():
    names = [f"s{n}" for n in range(10)]
    a, b = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.25 * 1009


@pytest.mark.parametrize(("shards", "size"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 1, 1_000_033)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_placement(spark, odd_documents, no_documents, tmp_path):
    placed = sharding.place(spark, odd_documents, "doc_id", ["a", "b", "c"], 13, fallback="text")
    assert placed.count() == odd_documents.count() and placed.where("shard is null").count() == 0
    assert placed.groupBy("doc_id").agg({"shard": "count"}).count() == odd_documents.select("doc_id").distinct().count()
    assert sharding.place(spark, no_documents, "doc_id", ["a"], 7).count() == 0
    sharding.write_sharded(placed, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_documents.count()


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 5, "user", None), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 1, "bot", "b"), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "x"), (6, None, "user", "x"), (7, 1, None, ""), (8, 3, "user", "a"), (8, 3, "bot", "z")]
    turns += [(9, n, "user", str(n)) for n in range(30)] + [(10, n, "user", str(n)) for n in range(29)]
    frame = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, part int")
    found = chat.render(frame, block=8).collect()
    assert {r["conv_id"]: r["n_turns"] for r in found} == {2: 3, 4: 1, 7: 1, 8: 2, 9: 30}
    text = "".join(r["text"] for r in sorted(found, key=lambda r: r["part"]) if r["conv_id"] == 9)
    assert text == "".join(f"<|user|>\n{n}<|end|>\n" for n in range(30)) and len([r for r in found if r["conv_id"] == 9]) == 4
    assert chat.render(frame.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from tarnwick.tables import read_table

    docs = read_table(spark, SMALL, "documents")
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    given = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) < set(given) and len(kept) > 0.4 * len(given)
    for r in kept.values():
        assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == r["decoded_sha256"] and len(r["token_ids"]) == 4 * r["n_tokens"]
        assert len((r["text"] or "").split()) <= len((given[r["doc_id"]]["text"] or "").split())


def test_pipeline_stages_handle_odd_documents(spark, odd_documents):
    import corpus_pipeline

    clash = odd_documents.selectExpr("*", "'mine' as kept", "1 as hit_spans", "source as `a.b`")
    for docs in (clash, clash.limit(0)):
        columns, tags = docs.columns, {(r["kept"], r["hit_spans"], r["score"], r["a.b"] == r["source"]) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = scratch.new_path(spark, "stage").replace("/tarnwick/", "/kept/")
            stage(spark, docs, SMALL).write.parquet(out)
            docs = spark.read.parquet(out)
            assert docs.columns[: len(columns)] == columns, name
            assert {(r["kept"], r["hit_spans"], r["score"], r["a.b"] == r["source"]) for r in docs.collect()} <= tags
        assert "ids_sha256" in docs.columns
