"""Near duplicates: what the count of links is, and copies that repeat a block."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from kinledger.llm import minhash


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_links_are_named_for_joining(spark, tmp_path):
    rng = random.Random(2)
    base = _words(rng, 120)
    texts = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(0, 120, 40)] + [" ".join(_words(rng, 50))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = minhash.op6_near_duplicates(spark, str(tmp_path))
    assert found.columns == ["doc_id", "class_id", "n_joins", "kept"]
    got = {r.doc_id: r for r in found.collect()}
    # a group of three is joined by two links or three; a text that stands alone has none
    assert all(got[i].class_id == 0 and got[i].n_joins >= 1 for i in range(3)) and got[3].n_joins == 0
    assert sum(got[i].n_joins for i in range(3)) in (4, 6)


@pytest.mark.parametrize("times", [10, 50])
def test_copies_with_a_repeated_block_are_found(spark, times):
    rng, texts = random.Random(times), {}
    for k in range(300):
        base = _words(rng, 150)
        block = base[: 70 if times == 10 else 50]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join([*block * times, *base[len(block) :]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert [i for i in texts if got[i] != i - i % 2] == []


def test_bands_of_texts_that_repeat_nothing_are_those_of_one_signature(spark):
    rng = random.Random(8)
    docs = [(0, " ".join(_words(rng, 80))), (1, "a b c d e f " * 9), (2, " "), (3, "one two")]
    got = {r.doc_id: len(r.bands) for r in minhash.sketch(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 3} and got[0] == got[3] == minhash.BANDS < got[1] <= 2 * minhash.BANDS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_on_the_table(spark):
    """Each pair of different texts of sf0.01 at a similarity of 0.8 or more, found by all shared shingles, is in one class,
    and classes hold nothing else."""
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sets, index, shared = {}, defaultdict(list), Counter()
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for x in sets[i]:
            shared.update((j, i) for j in index[x])
            index[x].append(i)
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    got, bands, up = {r.doc_id: r.class_id for r in minhash.op6_near_duplicates(spark, d).collect()}, defaultdict(lambda: [0, 0]), {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, j), x in alike.items():
        if x >= 0.8:
            band = "1" if texts[i] == texts[j] else f"{int(x * 20) / 20:.2f}"
            bands[band][0] += 1
            bands[band][1] += got[i] == got[j]
            a, b = sorted((root(i), root(j)))
            up[b] = a
    print({k: f"{found} of {n}" for k, (n, found) in sorted(bands.items())})
    assert sum(n for n, _ in bands.values()) > 50 and all(found == n for n, found in bands.values())
    assert got == {i: root(i) for i in texts}
