"""Every stage of the pipeline, on what its predecessor kept, against a plain
version."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from veilgraph.llm import langid, mixing, sharding

from . import plain
from .test_langid import plain_positions
from .test_mixing import filled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = " ".join(f"word{i}" for i in range(60))
    odd = [
        (9001, None, "en", "src1", 0), (9002, "", None, "src1", 0), (9003, "12 + 34 = ...", "fr", None, 13), (None, f"No id but letters. {long}", "en", None, 9),
        (9005, long, "en", "src1", 9), (9005, long, "en", "src1", 9), (9006, long, "de", "src2", 9), (None, f"No id but letters. {long}", "en", None, 9),
    ]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    odd += [(9007, f"Prefix {item} suffix", "es", "src3", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        docs = stage(spark, docs, folder)
        path = f"{folder}/stage{len(out)}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def test_columns(stages):
    assert all(columns == COLUMNS for _, columns, _ in stages[:-1])
    assert stages[-1][1] == [*COLUMNS, "slot", "shard"]


def test_language_stage(spark, stages, folder):
    """Against the network's scalar form: a document stays if it has a letter
    and its best language's mean probability is at least LEAST_SCORE."""
    before, _, after = stages[0]
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before)
    assert {9001, 9002, 9003} <= {x[0] for x in gone}
    net = langid.fit(spark.read.parquet(f"{folder}/documents.parquet").where(~langid.held_out()).select("doc_id", "text", "lang"))
    short = sorted({row for row in before if len(row[1] or "") < 700}, key=str)[:25]
    for row in short:
        p = plain_positions(net, row[1]) if row[1] else []
        sure = bool(p) and any(c.isalpha() for c in row[1]) and max(sum(c) / len(p) for c in zip(*p, strict=True)) >= corpus_pipeline.LEAST_SCORE
        assert (row not in gone) == sure


def test_near_duplicate_stage(stages):
    before, _, after = stages[1]
    fps = {row: plain.fingerprint(row[1]) for row in before}
    root = plain.components(fps.values(), 2)
    groups = defaultdict(list)
    for row in before:
        groups[root[fps[row]]].append(row)
    assert len(after) == len(groups)
    for row in after:
        ids = [x[0] for x in groups[root[fps[row]]] if x[0] is not None]
        assert row[0] == (min(ids) if ids else None)
    assert {root[fps[row]] for row in after} == set(groups)


def test_decontamination_stage(spark, stages, folder):
    before, _, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    found = plain.contamination([r[1] for r in before], items)
    want = Counter(row for row, (n, hit, _) in zip(before, found, strict=True) if not (hit > 0 and 20 * hit >= n))
    assert Counter(after) == want
    assert 9007 not in {r[0] for r in after}


def test_mixing_stage(stages):
    """Against a plain mix: targets by filling, then each source's documents
    in the order of their keyed hashes."""
    before, _, after = stages[3]
    sizes, of = Counter(), defaultdict(list)
    for row in before:
        sizes[row[3]] += len(plain.words(row[1]))
        of[row[3]].append(row)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: corpus_pipeline.SOURCE_WEIGHTS[k % 3] for k, s in enumerate(order)}
    target = filled(sizes, weights, corpus_pipeline.MIX_RATIO * sum(sizes.values()), corpus_pipeline.MAX_EPOCHS)
    key = lambda row: hashlib.md5("|".join([mixing.SEED, "" if row[0] is None else str(row[0]), hashlib.md5((row[1] or "").encode()).hexdigest()]).encode()).hexdigest()[:15]
    want = Counter()
    for s, rows in of.items():
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        left = target[s] - whole * sizes[s]
        for row in sorted(rows, key=key):
            n = len(plain.words(row[1]))
            want[row] += whole + (left > 0 and 2 * left >= n)
            left -= n
    assert Counter(after) == +want
    assert max(Counter(after).values()) <= 2


def test_sharding_stage(stages):
    before, _, after = stages[4]
    table = sharding.fill_table(sharding.NAMES)
    assert Counter(r[:5] for r in after) == Counter(before)
    for row in after:
        key = str(row[0]) if row[0] is not None else "text " + hashlib.md5((row[1] or "").encode()).hexdigest()
        slot = int(hashlib.md5(f"{sharding.SEED}|{key}".encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert row[5:] == (slot, table[slot])


def test_run(spark, folder, stages):
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter(got) == Counter(stages[-1][2])
