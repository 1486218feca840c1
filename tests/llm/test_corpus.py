"""Mixing, packing, sharding, the pipeline and the registered queries."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import _table
from rillstone.llm import mixing, packing, queries, sharding
from tests.llm import brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _documents(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 80))), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(n)]
    rows += [(1000, None, "s1"), (1001, "", "s2"), (1002, " \t\n ", None), (1003, "lone words", None), (1004, "x " * 5_000, "big"), (None, "no id here", "s0")]
    return rows + [rows[0], (7, "another text of seven", "s3"), (1005, None, "silent")]


@pytest.mark.parametrize("shard_rows", [9, 4096])
def test_mixture_meets_its_targets(spark, shard_rows):
    rows = _documents()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    found = mixing.mixed(docs, shard_rows=shard_rows).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(brute.WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, brute.water([sizes[s] for s in order], (3, 1, 2), 1.5, 2)))
    taken = dict.fromkeys(order, 0)
    shards = {s: 1 + sum(r["source"] == s for r in found) / shard_rows for s in order}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - targets[s]) <= mixing.BLOCK_WORDS * (1 + 2 * shards[s])
    again = mixing.mixed(docs.repartition(3, "text"), shard_rows=shard_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    made = mixing.mixture(docs, shard_rows=shard_rows)
    assert made.columns == docs.columns
    words = {}
    for r in made.collect():
        words[r["doc_id"], r["source"]] = words.get((r["doc_id"], r["source"]), 0) + len(brute.WORDS.findall(r["text"]))
    want = {}
    for r in found:
        if r["taken"]:
            want[r["id"], r["source"]] = want.get((r["id"], r["source"]), 0) + r["taken"]
    assert words == want


def test_rows_of_one_id_and_copies_of_one_row_are_spread(spark):
    alike = [(7, "a", "same words here")] * 700 + [(7, "a", f"text {i} of many") for i in range(700)]
    docs = spark.createDataFrame(alike + [(i, "a", "two words") for i in range(100, 900)] + [(None, "b", None)], "doc_id long, source string, text string")
    sized = mixing.sizes(docs)
    sources = sized.groupBy("source").agg(F.count("*").alias("n_rows")).withColumn("place", F.ascii("source"))
    dealt = mixing._dealt(sized.join(sources, "source"), 20, 100)
    held = dealt.groupBy("place", "shard").count().agg(F.max("count"), F.sum("count")).first()
    assert held[0] <= 200 and held[1] == docs.count()
    rows = mixing.mixed(docs, shard_rows=100).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    words, target = sum(r["taken"] for r in rows if r["source"] == "a"), next(r["target"] for r in rows if r["source"] == "a")
    shards = dealt.where("source = 'a'").select("shard").distinct().count()
    assert abs(words - target) <= 16 * (shards + 1)  # the last block of a shard's line may be a part
    again = mixing.mixed(docs, shard_rows=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, " ", None)], empty.schema)
    assert [(r["target"], r["taken"]) for r in mixing.mixed(silent).collect()] == [(0.0, 0)] * 2


@pytest.mark.parametrize("seed", range(4))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = [float(rng.choice([0, 10, 10, 33, rng.random() * 1000])) for _ in range(rng.randint(1, 12))]
    table = spark.createDataFrame([(f"s{i:02}", i, v) for i, v in enumerate(votes)], "source string, place long, target double")
    found = {r["place"]: r["blocks"] for r in mixing.source_quotas(table, 7).collect()}
    assert [found[i] for i in range(len(votes))] == brute.sainte_lague(votes, int(sum(votes) / 7 + 0.5))
    words = [rng.randint(0, 90) for _ in range(9)]
    shards = spark.createDataFrame([(None, i, w, 31) for i, w in enumerate(words)], "source string, shard int, words long, blocks long")
    found = {r["shard"]: r["quota"] for r in mixing.shard_quotas(shards).collect()}
    assert [found[i] for i in range(9)] == brute.sainte_lague(words, 31)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.tokenizer_path())
    made.encode_special_tokens = True
    return made


def test_ids_by_parts_are_the_ids_of_the_whole(tokenizer):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "!", " x", "the", "<|endoftext|>", "\x1c", "\x85", "　", "日本", "\U0001f600", ".\n"]
    encoder = packing.Encoder(queries.tokenizer_path())
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_gapless_and_reads_back(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["tree", "house", "über", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "word " * 900), (303, "a"), (303, "a"), (None, "b c")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, length int, offset string")
    found = packing.packed(docs, queries.tokenizer_path(), ["doc_id"], most=64, keep_ids=True, block_rows=7).collect()
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    texts = {}
    for r in found:
        texts.setdefault(r["doc_id"], []).append(r)
    for key, text in dict(rows).items():
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        own = sorted(texts[key], key=lambda r: r["piece"])
        if key == 303:
            assert [bytes(r["ids"]) for r in own] == [want, want]
            continue
        assert b"".join(bytes(r["ids"]) for r in own) == want
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert all(r["length"] == 64 for r in own[1:])
    total = sum(r["length"] for r in found)
    assert len(bins) <= -(-total // 64) + 2
    assert packing.packed(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_fullest_combination_and_cuts():
    from itertools import product

    rng = random.Random(3)
    for _ in range(40):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        sums = {sum(a * b for a, b in zip(counts, chosen)) for chosen in product(*[range(n + 1) for n in counts.values()])}
        found = packing.fullest(counts, 60)
        assert sum(found) == max(s for s in sums if s <= 60) and all(found.count(x) <= counts[x] for x in found)
        plan = packing.patterns(counts, 60)
        placed = {k: sum(lengths.count(k) * times for lengths, times in plan) for k in counts}
        assert placed == counts and all(sum(lengths) <= 60 for lengths, _ in plan)
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


@pytest.mark.parametrize("index_bits", [8, 30])
def test_only_oversized_buckets_split(spark, index_bits):
    import hashlib

    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(300)] + [(5, "y" * 90)] * 200 + [(400, "z" * 5_000), (401, None), (None, "n"), (402, "é" * 10)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, bytes int, shard string")
    found = sharding.sharded(docs, 2_000, index_bits=index_bits).collect()
    assert len(found) == len(rows)
    held, members = {}, {}
    for r in found:
        held[r["shard"]] = held.get(r["shard"], 0) + r["bytes"]
        members[r["shard"]] = members.get(r["shard"], 0) + 1
    assert all(b <= 2_000 or members[s] == 1 for s, b in held.items())
    bits = lambda key: bin(int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    size = lambda text: len((text or "").encode())
    below = {}
    for key, text in rows:
        own = bits(key)
        for d in range(61):
            below[own[:d]] = below.get(own[:d], 0) + size(text)
    for r in found:
        own = bits(r["id"])
        fits = [d for d in range(61) if below[own[:d]] <= 2_000]
        if fits:
            assert r["shard"] == own[: fits[0]] and r["depth"] == fits[0]
        else:
            assert r["shard"].startswith(own + "-")
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 100, "k") for i in range(50)], "doc_id long, text string, source string")
    sharding.write_sharded(docs, str(tmp_path / "out"), 1_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == 50
    assert back.groupBy("__shard").count().agg(F.max("count")).first()[0] <= 10


def test_repeated_and_null_ids_are_written_once_each(spark, tmp_path):
    rows = [(1, "same", "a"), (1, "same", "a"), (1, "other", "b"), (None, "lost", "c"), (None, None, None), (2, "", "x" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, serial string")
    for shard_bytes in (1, 8, 1_000):
        sharding.write_sharded(docs, str(tmp_path / str(shard_bytes)), shard_bytes)
        back = spark.read.parquet(str(tmp_path / str(shard_bytes))).select(docs.columns)
        assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


@tables
@pytest.mark.parametrize("folder", [FOLDER, FOLDER.replace("0.001", "0.01")])
def test_personal_data_is_counted_by_kind(spark, folder):
    """Every column of op10 but the spans that the trees add, which hold the base spans."""
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in queries.op10_pii_boosted_candidates(spark, folder).collect()}
    assert len(found) == len(texts)
    for doc, text in texts:
        spans, r = brute.pii(text), found[doc]
        listed = ",".join(f"{list(brute.PII)[k]}:{s}:{e}" for s, k, e in spans)
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@tables
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_with_sql(spark, db, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert _table(got.columns, [tuple(r) for r in got.collect()]) == _table(names, want.fetchall())


@tables
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_queries_without_sql_return_their_tables(spark, db, name):
    got = queries.QUERIES[name](spark, FOLDER)
    if name.startswith("op13"):
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]  # held against all pairs in test_spelling
        return
    table = {"op1": "pages", "op6": "embeddings", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    rows = db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name.startswith("op8"):
        rows = 10 * db.execute("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0").fetchone()[0]
    if name.startswith("op12"):
        rows *= 8
    if name.startswith("op9"):
        assert got.select("doc_id").distinct().count() == rows
    else:
        assert got.count() == rows


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = queries.read(spark, FOLDER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        assert made.columns == columns
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = [(r["doc_id"], r["text"]) for r in made.collect()]
        assert {i for i, _ in after} <= set(before)
        if name == "simhash_near_duplicates":
            assert sorted(i for i, _ in after) == sorted(set(brute.simhash_components(sorted(before.items()))[1]))
        if name == "pii":
            assert {i for i, _ in after} == set(before) and not any(brute.pii(t) for _, t in after)
        docs = made
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    total, bins = last.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert -(-total // 1024) <= bins <= -(-total // 1024) * 1.02 + 2
    assert corpus_pipeline.run(spark, FOLDER).count() == last.count()


def test_pipeline_takes_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    folder = FOLDER
    for rows in ([], [(None, None, None, None, None, "a"), (1, "", "en", None, 0, "b"), (1, "", "en", None, 0, "b"), (2, "few words", None, "s", 9, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, folder), "odd")
        assert docs.count() >= 0


def test_ids_are_those_of_the_tokenizer_as_the_file_makes_it(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "'s", "é", " the", "<|endoftext|>", "<|endoftext", "|>", "日本"]
    texts = ["a <|endoftext|> b", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500))]
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert want[0] == np.array([64, 220, 50256, 275, 2], "<u4").tobytes()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.packed(docs, queries.tokenizer_path(), keep_ids=True).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in found} == dict(enumerate(want))
