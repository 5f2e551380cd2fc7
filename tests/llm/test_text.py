"""Byte-level helpers and the operators on texts, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from kinledger.llm import bytetext as b
from kinledger.llm import decontaminate, extract, linechunks, quality, toxicity

TEXTS = st.lists(st.none() | st.text(alphabet="aB9 \n\t.\u00e9\u4e2d#|<x", max_size=60), max_size=8)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 50))
def test_words_lines_and_blocks(texts, most):
    column = pa.array(texts, pa.string())
    words, lines, rows = [[] for _ in texts], [[] for _ in texts], 0
    for first, data, offsets in b.blocks(column, most):
        raw = data.tobytes()
        for s, e, r in zip(*b.spans(b.NOT_SPACE[data], offsets)):
            words[first + r].append(raw[s:e].decode())
        for s, e, r in zip(*b.lines(data, offsets)):
            lines[first + r].append(raw[s:e].decode())
        rows += len(offsets) - 1
    assert rows == len(texts)
    assert words == [SPACE.findall(t or "") for t in texts]
    assert lines == [(t or "").split("\n") for t in texts]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_equal_shingles_have_equal_hashes(texts):
    seen = {}
    for _, data, offsets in b.blocks(pa.array(texts, pa.string())):
        start, end, row = b.spans(b.ALNUM[data], offsets)
        rows, hashes = b.shingles(b.span_hashes(b.LOWER[data], start, end), row, 5)
        got = [set() for _ in texts]
        for r, h in zip(rows, hashes):
            got[r].add(int(h))
        for i, t in enumerate(texts):
            w = ALNUM.findall((t or "").translate(LOWER))
            want = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            assert len(got[i]) == len(want)
            assert seen.setdefault(frozenset(want), got[i]) == got[i]


def base(t):
    w = SPACE.findall(t)
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [0] * len(w)
    for i in range(len(w) - 4):
        if five[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [1] * 5
    seen, again = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, sum(mark)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_base_counts(texts):
    got = []
    for _, data, offsets in b.blocks(pa.array(texts, pa.string())):
        s, e, r, w = quality.words_of(data, offsets)
        got += zip(*quality.base_counts(data, offsets, s, e, r, w).values())
    assert [tuple(map(int, g)) for g in got] == [base(t or "") for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB \n.", max_size=80), st.text(alphabet="aB \n.", max_size=30))
def test_chunks_cover_texts(text, other):
    _, data, offsets = next(b.blocks(pa.array([other, text])))
    start, end, row, words = linechunks._worded_lines(data, offsets)
    low, high = linechunks.chunk_lines(data, start, end, row, 2)
    assert [i for a, z in zip(low, high) for i in range(a, z + 1)] == list(range(len(row))) and (row[low] == row[high]).all()
    assert words[row == 1].sum() == len(SPACE.findall(text))
    raw = data.tobytes()
    for r, x, y, a, z, _ in zip(*linechunks.pieces(data, offsets, 2, 1, 3)):
        mine = raw[offsets[r] + a : offsets[r] + z].decode()
        assert [k for k in mine.split("\n") if SPACE.search(k)] == [k for k in (other, text)[r].split("\n") if SPACE.search(k)][x : y + 1]


def test_hits_map_to_the_original():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    automaton.add_word(" b c ", (2, ("1",)))
    automaton.add_word(" c b ", (2, ("2",)))
    automaton.make_automaton()
    text = "\u00e9a B\u2014, c-b; B.C"
    n, words, items = decontaminate.hits(automaton, text.replace("\u2014", "").encode())
    assert (n, words.tolist(), items) == (6, [1, 2, 3, 4, 5], {"1", "2"})
    text = "\u00e9\u00e9 B, c x"
    _, words, _ = decontaminate.hits(automaton, text.encode())
    ((span),) = decontaminate.character_spans(text.encode(), words)
    assert text[span["start"] : span["end"]] == "B, c"


def test_toxicity_learns_and_reads_misspellings():
    rng = random.Random(3)
    plain = [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('rstuv')}" for _ in range(60)]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            for k in rng.sample(range(30), 3):
                words[k] = rng.choice(["stupidly", "stupid", "wretched"])
        texts.append(" ".join(words))
        labels.append(i % 4 == 0)
    bags = toxicity.bags(pa.array(texts))
    model = toxicity.train(np.diff(bags.offsets.to_numpy()), *toxicity.unbagged(bags.flatten().to_numpy()), np.array(labels, float))
    scores = model.scores(pa.array(texts))
    assert scores[np.array(labels)].min() > 0.3 > scores[~np.array(labels)].max()
    unseen = " ".join(plain[:27] + ["stuupid", "stupidd", "wretchhed"])
    assert model.scores(pa.array([unseen, " ".join(plain[:30])]))[0] > 0.3 > model.scores(pa.array([" ".join(plain[:30])]))[0]


def test_extraction_of_layouts():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><a href=/>menu</a></nav><div class="notice">cookies!</div>
    <article><header><h1>The title</h1></header><p>One &amp; two,\n  three<b>four</b> &lt;5&gt;.</p><aside>aside</aside>
    <div class="ad">buy</div><p>Last one.</p><form>a form</form><div id="comments"><p>first!</p></div><script>var x = "</p>"</script></article>
    <aside>side</aside><footer>foot</footer></body></html>"""
    assert extract.main_text(page) == "The title One & two, threefour <5>. Last one."
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>menu</nav>") == ""
    for page in extract.LABELLED[:5]:
        want = " ".join(extract.main_text(f"<article>{part}</article>") for part in re.findall("\x02(.*?)\x03", page, re.S))
        assert extract.main_text(page.replace("\x02", "").replace("\x03", "")) == want


def test_best_run_is_the_greatest():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, z = extract.best_run(x)
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert sum(x[a:z]) == max(best, 0)
