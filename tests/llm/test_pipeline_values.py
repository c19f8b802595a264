"""Every stage of the pipeline against plain Python over the same rows."""

import collections
import itertools

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from samples import prose
from test_text_operators import WORD, brute_recurring

from sievelake.llm import mixing, quality

STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(prose(3000, 80).split())
ROWS = [(i, f"{prose(40 * i, 60)}\nA {i} short record of the copper mill {i}", "en", f"s{i % 3}") for i in range(40)]
ROWS += [(100 + k, f"{prose(6000 + k, 90)}\n{LONG}", "en", "s0") for k in range(4)]  # one long passage in documents of their own
ROWS += [(200 + k, prose(7000, 100).replace(" ", " x ", 1 + (k > 1)), "en", "s1") for k in range(4)]  # near copies and copies
ROWS += [(300, None, None, None), (301, "", "en", "s0"), (302, prose(7000, 100), "en", "s1"), (None, prose(8000, 40), "en", "s2"), (None, prose(8000, 40), "en", "s2"), ROWS[3]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)


def stage(name, spark, table):
    out = STAGES[name](spark, table, "")
    assert name == "packing" or out.columns == table.columns
    return out.collect()


def test_quality(spark, table):
    kept = collections.Counter(r.doc_id for r in quality.quality_rules(table).collect() if r.kept)
    assert collections.Counter(r.doc_id for r in stage("quality", spark, table)) == kept
    assert 300 not in kept and 301 not in kept


def test_lines(spark, table):
    """Lines of recurring templates and the later copies of the long passage go; a near copy of its first holder would stay whole."""
    gone = brute_recurring([(i, t) for i, t, *_ in ROWS])
    want = collections.Counter()
    for i, text, *_ in ROWS:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x not in gone[i, text or ""] and not (x == LONG and i != 100)]
        if WORD.search("\n".join(kept)):
            want[i, "\n".join(kept)] += 1
    assert collections.Counter((r.doc_id, r.text) for r in stage("lines", spark, table)) == want


def test_near_duplicates(spark, table):
    def shingles(text):
        words = WORD.findall((text or "").lower())
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t, *_ in ROWS]
    parent = list(range(len(ROWS)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(ROWS)), 2):
        if sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, *_) in enumerate(ROWS):
        groups[find(k)].append((i is None, i))
    want = collections.Counter(min(g)[1] for g in groups.values())
    assert collections.Counter(r.doc_id for r in stage("near_duplicates", spark, table)) == want
    assert len(groups) < len(ROWS) - 5


def test_mixture(spark, table):
    want = collections.Counter()
    for r in mixing.mixed(table).collect():
        if r["size"]:
            want[r.doc_id] += (2 * r.taken + r["size"]) // (2 * r["size"])
    assert collections.Counter(r.doc_id for r in stage("mixture", spark, table)) == +want


def test_packing(spark, table):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stage("packing", spark, table)
    want = collections.Counter()
    for i, text, *_ in ROWS:
        want[i] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in pieces:
        got[r.doc_id] += r.length
    assert got == want
    places = np.sort([2048 * r.sequence_id + r.offset for r in pieces])
    assert places[0] == 0 and sum(want.values()) == max(2048 * r.sequence_id + r.offset + r.length for r in pieces)


def test_extra_columns(spark, table):
    """Names that need quotes or that helper columns have pass through every stage."""
    from pyspark.sql import functions as F

    odd = ["a.b", "a`b", "row", "nth", "__id", "n_lines", "n_dropped", "whole", "copies", "kept", "stats", "class", "part"]
    wide = table.withColumns({c: F.lit(c) for c in odd})
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, wide, "")
        assert out.columns == wide.columns, name
        assert all(tuple(r[c] for c in odd) == tuple(odd) for r in out.collect()), name
    assert STAGES["packing"](spark, wide, "").count() > 0
