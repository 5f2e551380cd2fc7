"""Line dedup on passages of short lines, against a search of all runs of lines."""

import random

import numpy as np
from kinledger.llm import linechunks


def _cases():
    """(host of the first occurrence, host of the later one, passage): lines of 3 to 7 words, 51 to 80 in all."""
    rng = random.Random(17)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    for k in range(240):
        passage, most = [], rng.randint(51, 74)
        while sum(len(x.split()) for x in passage) < most:
            passage.append(line(rng.randint(3, 7)))
        near = (3, 7) if k % 2 else (12, 25)
        hosts = [[line(rng.randint(*near)) for _ in range(rng.randint(2, 6))] for _ in range(2)]
        yield passage, [(h[: (at := rng.randint(0, len(h)))], h[at:]) for h in hosts]


def test_passages_of_short_lines_go_to_the_last_line(spark):
    texts, want = {}, {}
    for k, (passage, hosts) in enumerate(_cases()):
        for i, (before, after) in enumerate(hosts):
            texts[2 * k + i] = "\n".join([*before, *passage, *after])
            want[2 * k + i] = "\n".join([*before, *(passage if i == 0 else []), *after])
    out = {r.doc_id: r for r in linechunks.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [i for i in texts if out[i].text != want[i]] == []
    assert all(out[i].n_words_removed == len(texts[i].split()) - len(want[i].split()) for i in texts)


def test_windows_are_those_of_a_search_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        rows = [[rng.choice((1, 2, 3, 9, 30)) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        want, first = set(), 0
        for words in rows:
            for i in range(len(words)):
                for j in range(i, len(words)):
                    if sum(words[i : j + 1]) >= 20 and (sum(words[i:j]) < 20 or sum(words[i + 1 : j + 1]) < 20):
                        want.add((first + i, first + j))
            first += len(words)
        row = np.repeat(np.arange(4), [len(x) for x in rows])
        low, high = linechunks.window_lines(row, np.array(sum(rows, []), int), 20)
        assert set(zip(low.tolist(), high.tolist())) == want


def test_covering_stands_on_the_same_lines():
    rng = random.Random(7)
    for _ in range(300):
        runs = sorted({(a := rng.randint(0, 20), a + rng.randint(0, 6)) for _ in range(rng.randint(0, 12))})
        low, high = [x for x, _ in runs], [y for _, y in runs]
        taken = linechunks.covering(low, high)
        union = lambda at: {k for i in at for k in range(low[i], high[i] + 1)}
        assert union(taken) == union(range(len(runs)))
        assert all(sum(low[i] <= k <= high[i] for i in taken) <= 2 for k in range(30))


def _removed_by_hand(texts: dict[int, str]) -> dict[int, str]:
    """All chunks and windows of all documents, by their text and in order of doc_id."""
    cut, first, out = {}, {}, {}
    for i in sorted(texts):
        data, offsets = np.frombuffer(texts[i].encode(), np.uint8), np.array([0, len(texts[i].encode())])
        start, end, row, words = linechunks._worded_lines(data, offsets)
        lines = texts[i].split("\n")
        worded = [k for k, x in enumerate(lines) if x.split()]
        runs = {(a, b) for a, b in zip(*(x.tolist() for x in linechunks.chunk_lines(data, start, end, row))) if b > a and sum(len(lines[k].split()) for k in worded[a : b + 1]) >= linechunks.CHUNK_WORDS}
        runs |= set(zip(*(x.tolist() for x in linechunks.window_lines(row, words))))
        cut[i] = lines, worded, sorted(runs)
        for a, b in sorted(runs):
            first.setdefault("\n".join(lines[worded[a] : worded[b] + 1]), (i, b))
    for i, (lines, worded, runs) in cut.items():
        gone = set()
        for a, b in runs:
            doc, last = first["\n".join(lines[worded[a] : worded[b] + 1])]
            if doc != i or a > last:
                gone |= set(range(worded[a], worded[b] + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_all_chunks_of_a_corpus_with_inserted_lines(spark):
    rng, texts = random.Random(23), {}
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(rng.choice((1, 3, 8, 12, 20, 55))))
    shared = [line() for _ in range(40)]
    for i in range(0, 120, 3):
        base = [rng.choice(shared) if rng.random() < 0.3 else line() for _ in range(rng.randint(4, 25))]
        for k in range(3):  # copies with lines inserted, dropped, repeated, and blank ones
            mine = list(base)
            for _ in range(rng.randint(0, 3)):
                mine.insert(rng.randint(0, len(mine)), rng.choice((line(), "", rng.choice(shared))))
            if rng.random() < 0.3:
                del mine[rng.randrange(len(mine))]
            if rng.random() < 0.2:
                mine += ["a b"] * 80
            texts[i + k] = "\n".join(mine)
    want = _removed_by_hand(texts)
    out = {r.doc_id: r for r in linechunks.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    assert [i for i in texts if out[i].text != want[i]] == []
    assert all(out[i].n_words_removed == len(texts[i].split()) - len(want[i].split()) for i in texts)
    assert sum(want[i] != texts[i] for i in texts) > 60
