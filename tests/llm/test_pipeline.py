"""The corpus pipeline stage by stage against plain Python, and as a whole."""

import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as P
from weftgraph.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 3000, n))


def documents():
    rows, shared = [], prose(12, 9_000)
    for k in range(60):
        lines = [prose(14, 100 * k + j) for j in range(3)]
        if k % 4 == 0:
            lines.insert(1, shared)
        if k % 7 == 0:
            lines.append(shared[:-1] + "x")
        rows.append((k, "\n".join(lines), "en", "big" if k % 3 else "small"))
    rows += [(100 + k, rows[k][1] + (" tail" if k % 2 else ""), "en", "big") for k in range(12)]  # copies and near copies
    rows += [(200 + k, "### | ### | " * 12, "en", "big") for k in range(3)]  # junk
    rows += [(300, None, "en", "small"), (301, "", "en", None), (302, prose(2500, 5), None, "small"), (5, rows[5][1], "en", "big"), (None, prose(30, 77), "en", "big")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"file://{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(200 + k, 0, 0) for k in range(3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return Counter(tuple(r) for r in df.select(*P.COLUMNS).collect())


def test_quality(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = quality.fit_rules(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = plain(P.quality(spark, docs, folder))
    expected = Counter()
    for r in documents():
        numbers = dict(zip((x.split()[0] for x in quality.STATISTICS.split(", ")), quality.statistics_of((r[1] or "").encode()), strict=True))
        values = {k: np.array([numbers[a] / max(1, numbers[b]) if b else float(numbers[a])]) for k, (a, b) in quality.FEATURES.items()}
        failed = numbers["n_words"] < 10 or 100 * numbers["n_repeat_words"] > 20 * numbers["n_words"]
        if not failed and not any(quality._covered(rule, values, 1)[0] for rule in rules):
            expected[r] += 1
    assert found == expected
    kept = {k[0] for k in found}
    assert not kept & {200, 201, 202, 300, 301} and set(range(60)) - {0, 28, 56} <= kept  # these three repeat a line


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def test_lines(spark, folder):
    rows = [r for r in documents() if r[0] is not None and r[0] != 302 and r[1] is not None]
    rows = list({r[0]: r for r in rows}.values())
    earlier, expected = [], Counter()
    for r in sorted(rows):
        left = []
        for line in r[1].split("\n"):
            if not line.strip():
                left.append(line)
                continue
            near = len(line) >= 20 and any(len(x) >= 20 and one_edit(line, x) for x in earlier)
            if line not in earlier and not near:
                left.append(line)
            earlier.append(line)
        if any(x.strip() for x in left) or not r[1].strip():
            expected[(r[0], "\n".join(left), *r[2:4], len("\n".join(left)))] += 1
    assert plain(P.lines(spark, table(spark, rows), folder)) == expected


def test_near(spark, folder):
    rows = documents()
    by = {r[0]: r for r in rows if r[0] is not None}
    sets = {}
    for k, r in by.items():
        w = (r[1] or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in by}
    for a, b in combinations(sorted(by), 2):
        same = (by[a][1] or "") == (by[b][1] or "")
        if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    expected = Counter(by[k] for k in by if group[k] == k) + Counter(r for r in rows if r[0] is None)
    assert plain(P.near(spark, table(spark, rows), folder)) == expected


def test_mix(spark, folder):
    rows = documents()
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").encode()) + 1
    total, roots = sum(size.values()), sum(math.sqrt(x) for x in size.values())
    expected = Counter()
    for r in rows:
        rate = math.sqrt(size[r[3]]) / roots * total / size[r[3]]
        u = (int(hashlib.md5(f"17|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        n, below = 0, math.exp(-rate)
        while below <= u:
            n += 1
            below += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        expected[r] += n
    assert plain(P.mix(spark, table(spark, rows), folder)) == +expected


def test_pack(spark, folder):
    from tokenizers import Tokenizer

    rows = documents()
    found = P.pack(spark, table(spark, rows), folder).collect()
    tokenizer = Tokenizer.from_file(P.TOKENIZER)
    tokens = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in {(r[0], r[1]) for r in rows}}
    times = Counter(r[0] for r in rows)
    for k in tokens:
        own = [r for r in found if r.doc_id == k]
        assert sum(r.length for r in own) == tokens[k] * times[k] and sum(r.piece == 0 for r in own) == times[k]
    fill = Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, folder, k):
    found = P.STAGES[k][1](spark, table(spark, []), folder)
    assert found.count() == 0 and (k == 4 or found.columns == list(P.COLUMNS))


def test_run_is_the_stages_in_a_row(spark, folder):
    assert [name for name, _ in P.STAGES] == ["quality", "lines", "near", "mix", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in P.STAGES[:-1]:
        docs = table(spark, [tuple(r) for r in step(spark, docs, folder).select(*P.COLUMNS).collect()])
    pieces = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    found = pieces(P.run(spark, folder))
    assert found == pieces(P.pack(spark, docs, folder)) and sum(found.values()) > 40
