"""Packing, sharding, BPE, top-k, host reputation, motion JPEG and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import bpe, mjpeg, packing, queries, sharding, tokens, url_reputation, vafile
from strataloom.llm.common import prepare
from tests.oracle import connect, same_rows

DOCS = "doc_id long, text string"
ODD = [(1, "plain text"), (2, None), (3, ""), (4, "<|endoftext|> x"), (None, "null id"), (4, "<|endoftext|> x"), (5, "word " * 6000), (6, "é漢́ \U0001f600")]


@pytest.fixture(autouse=True)
def _batches(spark):
    prepare(spark)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    same_rows(queries.queries()[name](spark, folder), connect(folder), queries.oracle_sql()[name])


def test_packing_is_a_partition_of_the_tokens(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = packing.pack_documents(docs, tokens.byte_encoder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in ODD:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = len(ids) % 2048
        cuts = [0, *range(at or 2048, len(ids) + 1, 2048)]
        want += [(doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, [tuple(r)[:5] for r in rows])) == sorted(map(str, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert packing.pack_documents(spark.createDataFrame([], DOCS), tokens.byte_encoder).count() == 0


def test_genetic_search_improves_on_best_fit():
    rng = random.Random(0)
    halves = [rng.randint(300, 700) for _ in range(60)]
    sizes = np.array([x for h in halves for x in (h, 1000 - h - h // 3, h // 3)])
    first = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 1000)
    best = packing.evolve(sizes, [], 1000, 1, members=10, generations=60)
    assert packing.fitness(sizes, best, 1000) >= packing.fitness(sizes, first, 1000)
    assert packing.fills(sizes, best).max() <= 1000 and packing.fills(sizes, best).sum() == sizes.sum()
    a, b = (packing.best_fit(sizes, np.random.default_rng(s).permutation(len(sizes)), 1000) for s in (1, 2))
    child = packing.crossover(sizes, a, b, 1000, rng)
    assert packing.fills(sizes, child).max() <= 1000 and packing.fills(sizes, child).sum() == sizes.sum()
    whole = {tuple(np.flatnonzero(b == k)) for k in range(b.max() + 1)}
    assert whole & {tuple(np.flatnonzero(child == k)) for k in range(child.max() + 1)}


def test_sharding_law_and_slots(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)] + ODD, DOCS)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == 3000 + len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    grown = dict(sharding.two_pass_shuffle(docs.select("doc_id"), "doc_id", F.lit(1), F.lit(0), 25).select("doc_id", "shard").collect())
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)
    texts = {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert all((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) in texts for d, t in ODD)
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    order = [r["doc_id"] for r in sorted((r for r in rows if r["shard"] == 3), key=lambda r: r["slot"])]
    assert order != sorted(order, key=lambda d: -1 if d is None else d)


def test_sharding_slots_do_not_depend_on_partitions(spark, monkeypatch):
    """Nor do equal records crowd one bucket: a third of all rows repeats one record."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    rows = [(i, f"{i} " * (i % 30)) for i in range(1200)] + [(7, "again and again")] * 600 + [(None, None)] * 90
    docs, got, before = spark.createDataFrame(rows, DOCS), [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        crowd = sharding.scatter(docs.repartition(n), "doc_id", size, F.crc32(F.coalesce("text", F.lit(""))), 24, 20)[0].where("doc_id = 7").groupBy("_shuffle_bucket").count()
        assert crowd.count() > 1 and crowd.agg(F.max("count")).first()[0] <= 301  # 600 equal records and the one that the range gives, over two buckets
        found = sharding.shard_documents(docs.repartition(n)).collect()
        assert len(found) == len(rows)
        got.append(sorted(str(tuple(r)) for r in found))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_sharding_digest_comes_from_written_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 14)
    paths = []

    def write(shuffled, path, shards, real=sharding.write_shards):
        paths.append(path)
        real(shuffled, path, shards)

    monkeypatch.setattr(sharding, "write_shards", write)
    texts = [(i, f"{i} " * (i * 7 % 900)) for i in range(1500)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, DOCS)).collect()
    held = {(r["doc_id"], r["shard"], r["slot"]): r["text"] for r in spark.read.parquet(paths[0]).collect()}
    assert sorted((k[0], v) for k, v in held.items()) == texts
    assert {(r["doc_id"], r["shard"], r["slot"]): (r["size"] - 8, r["text_crc32"]) for r in rows} == {k: (len(v), zlib.crc32(v.encode())) for k, v in held.items()}


def test_shards_on_disk_keep_their_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], DOCS)
    mixed = sharding.two_pass_shuffle(docs, "doc_id", F.octet_length("text"), F.crc32("text"), 4)
    sharding.write_shards(mixed, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["text"] for r in back.collect()) == sorted(f"t{i}" for i in range(400))


def test_bpe_equals_the_library(spark):
    path = tokens.vocabulary("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), bpe.WordEncoder(path)
    rng = random.Random(2)
    pools = ["abcdefthe ", "".join(map(chr, range(32, 0x250))), "éÀßΣσςİıſﬁ's've 1½²漢字한국어́‍ ", "'sT \n\t"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 60))) for p in pools for _ in range(150)] + ["<|startoftext|>a<|endoftext|>", "a" * 500]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert enc.encode(x) == ids and enc.decode(ids) == t.decode(ids, skip_special_tokens=False)
    docs = spark.createDataFrame(ODD, DOCS)
    rows = bpe.round_trip_digest(docs, path).collect()
    for (doc, text), r in zip(sorted(ODD, key=str), sorted(rows, key=lambda r: str((r["doc_id"], dict(ODD)[r["doc_id"]])))):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    ids = bpe.encode(docs, path)
    assert bpe.decode(ids, path).count() == len(ODD)


def test_prefix_tokens_are_those_of_each_prefix():
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "bc": 4, "abc": 5, "aa": 6}
    model = bpe.PrefixBpe(vocab, [("b", "c"), ("a", "b"), ("a", "a"), ("a", "bc")], "")

    def plain(symbols):
        parts = [vocab[s] for s in symbols]
        while True:
            found = [(model.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in model.rank]
            if not found:
                return parts
            r, i = min(found)
            parts[i : i + 2] = [next(t for t, m in model.made.items() if m == r)]

    rng = random.Random(3)
    for _ in range(2000):
        s = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        assert model.encode_symbols(s) == plain(s)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 8))
    m[50:120] = m[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, []), (904, [1.0] * 3), (905, [2.0] * 3), (0, [float(x) for x in m[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    marks = lambda i: (i % 100 == 0) | i.isin(904, 60)
    counts = {}
    got = sorted(map(tuple, vafile.top_k(df, marks, counts=counts).collect()))
    q = np.floor(1024 * m).astype(int)
    q, ids = np.vstack([q, q[0]]), [*range(300), 0]  # row 300 repeats row 0, id and all
    want = []
    for i in (0, 60, 100, 200, 300):
        s = q @ q[i]
        best = sorted((-int(s[j]), ids[j]) for j in range(301) if j != i)[:10]
        want += [(ids[i], k + 1, j, -x) for k, (x, j) in enumerate(best)]
    want.append((904, 1, 905, 3 * 1024 * 2048))
    assert got == sorted(want)
    assert 0 < counts["read"] < counts["pairs"] / 2
    assert vafile.top_k(df.limit(0), marks).count() == 0


def test_top_k_scans_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "DATA_BLOCK", 50)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(240, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vafile.top_k(df, lambda i: i % 20 == 0, k=5).collect()))
    q = np.floor(1024 * m).astype(int)
    want = [(i, k + 1, j, -x) for i in range(0, 240, 20) for k, (x, j) in enumerate(sorted((-int(q[j] @ q[i]), j) for j in range(240) if j != i)[:5])]
    assert got == sorted(want)


def test_host_reputation_rules_and_odd_urls(spark):
    urls = ["https://Sub.Example.com/en/1", "http://www.example.com/en/", "http://a.net/es/x?y", "http://a.net/de/", None, "no scheme", "https://user@h.co.uk:80/p#q", "http://x.com", "http://notexample.com/en/", "http://a.com/EN/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    good = spark.createDataFrame([(3, 0), (3, 0), (6, 1), (None, 1), (99, 1), (4, None)], "page_id long, good int")
    r = {x["page_id"]: x for x in url_reputation.judge_pages(pages, good).collect()}
    assert [r[i]["rule"] for i in range(10)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, "com/", "com/"]
    assert (r[0]["host"], r[0]["path"], r[0]["verdict"]) == ("sub.example.com", "/en/1", "block")
    assert (r[4]["host"], r[4]["path"]) == ("", "") and (r[6]["host"], r[6]["path"]) == ("user@h.co.uk:80", "/p")
    assert r[3]["good_rate"] < r[6]["good_rate"] and r[3]["n_labelled"] == 2
    assert url_reputation.judge_pages(pages.limit(0), good.limit(0)).count() == 0
    host = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("1.2.3.4",)], "h string")
    assert [x[0] for x in host.select(url_reputation.domain_of(F.col("h"))).collect()] == ["b.co.uk", "y.com", "com", "1.2.3.4"]


def test_motion_jpeg_round_trip(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = mjpeg.digest(mjpeg.read(mjpeg.store(docs))).collect()
    want = []
    for doc, text in ODD:
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw) % 64) or (0 if raw else 64))
        want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(str, [tuple(r)[:5] for r in rows])) == sorted(map(str, want))
    assert len({r["media_sha256"] for r in rows if r["doc_id"] == 4}) == 1
    clips = mjpeg.clip_rows(mjpeg.read(mjpeg.store(docs))).where("id = 5").collect()
    assert clips[0]["first"] == 0 and clips[0]["start_ms"] == 0


def test_avi_without_an_index_and_shots():
    a, b = bytes([30] * 2048), bytes([200] * 2048)
    frames = mjpeg.encode_frames(a * 4 + b * 5)
    data = mjpeg.write_avi(frames, 512, 256)
    avi = mjpeg.parse_avi(data)
    bare = mjpeg.parse_avi(data[: data.index(b"idx1")])
    assert avi.frames == bare.frames and len(avi.frames) == 9 and avi.rate == 25 and (avi.width, avi.height) == (512, 256)
    luma, hist = mjpeg.decode_files([data], [avi])[0]
    assert luma.tobytes() == a * 4 + b * 5
    assert [(c["first"], c["last"], c["end_ms"]) for c in mjpeg.shots(luma, hist, avi.rate)] == [(0, 3, 160.0), (4, 8, 360.0)]
    with pytest.raises(ValueError):
        mjpeg.parse_avi(b"RIFFxxxxWAVE")


def test_baseline_decoder_reads_coefficients():
    """A frame with AC coefficients and no restart markers, put together bit by bit."""
    bits = ""
    dc = {0: "00", 3: "01"}
    ac = {0x00: "00", 0x02: "01", 0xF0: "100"}
    for diff in (5, -6):
        bits += dc[3] + format(diff if diff > 0 else diff + 7, "03b") + ac[0x02] + "11" + ac[0xF0] + ac[0x02] + "01" + ac[0x00]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = mjpeg._head(16, 8, 0).replace(mjpeg._DC, mjpeg._table(0, 0, [0, 2, *[0] * 14], [0, 3])).replace(mjpeg._AC, mjpeg._table(1, 0, [0, 2, 1, *[0] * 13], [0x00, 0x02, 0xF0]))
    data = head + scan + b"\xff\xd9"
    c = mjpeg.decode_coefficients([mjpeg._parse_jpeg(data)])[0][0]
    assert c[:, 0].tolist() == [5, -1] and c[:, 1].tolist() == [3, 3] and c[:, 18].tolist() == [-2, -2] and np.count_nonzero(c) == 6
    plane = mjpeg.decode_jpeg(data)[0]
    full = np.zeros(64)
    full[mjpeg.ZIGZAG] = c[0].astype(int) * 8
    want = np.array([[sum(full.reshape(8, 8)[v, u] * (0.125 if u == v == 0 else 0.25 * (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1)) * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    assert plane.shape == (8, 16) and np.abs(plane[:, :8] - np.clip(np.rint(want) + 128, 0, 255)).max() <= 1


def test_line_stage_keeps_what_only_one_document_says(spark):
    import corpus_pipeline

    shared = "\n".join(" ".join(f"shared{i}word{'abcdefgh'[j % 8] * (j % 5 + 1)}" for j in range(60)) for i in "klmnopqr")
    texts = [(0, shared), (1, shared + "\nonly this document says it"), (2, shared + "\n--"), (3, "--")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(texts, DOCS), "").collect()}
    assert set(got) == {0, 1, 3} and got[1] == "only this document says it"


def test_pipeline_keeps_one_of_each_and_drops_toxic(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    odd = docs.limit(60).withColumns({c: F.lit(c) for c in ("n_lines", "n_gone", "toxicity", "lang_pred", "lang_score", "id", "doc", "t", "c0")}).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]), allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, folder)
        assert "toxicity" in odd.columns and odd.columns[: len(docs.columns)] == docs.columns
    assert odd.count() > 0
    kept = {r["doc_id"] for r in rows}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    assert len(kept & toxic) <= 0.25 * len(toxic)
    copies = {}
    for r in docs.collect():
        copies.setdefault(r["text"], []).append(r["doc_id"])
    assert all(len(kept.intersection(c)) <= 1 for c in copies.values())
    alone = {c[0] for c in copies.values() if len(c) == 1} - toxic
    assert len(kept & alone) >= 0.85 * len(alone)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 for p in by.values())
