"""Operators as Spark jobs, against brute force and exact round trips."""

import gzip
import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from kinledger.llm import chat, components, linechunks, minhash, mixing, urlfilter, warc
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def classes(texts):
    """Least id of each text's group by all pairs of shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = ALNUM.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) / len(a | b) >= 0.8:
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: root(i) for i in texts}


@pytest.fixture(scope="module")
def edited():
    """Families of edited copies: of one large text many, of some few, and texts alone."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, i = {}, 0
    for size in (150, 9, 5, 2, 2, *[1] * 30):
        base = [word() for _ in range(rng.choice((60, 110)))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4, 6))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy = copy[: int(len(copy) * rng.uniform(0.7, 1))]
            texts[i] = " ".join(copy)
            i += 1
    return texts


@pytest.mark.parametrize("levels", [2, 1, 0])
def test_near_duplicates_against_all_pairs(spark, edited, monkeypatch, levels):
    monkeypatch.setattr(minhash, "LEVELS", max(levels, 1))
    if not levels:  # all buckets by pivots
        monkeypatch.setattr(minhash, "SMALL", 2)
        monkeypatch.setattr(minhash, "PIVOTS", 1)
    docs = spark.createDataFrame(list(edited.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == classes(edited)


def test_signature_agreement_is_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(5)
    elements = rng.integers(1, 2**63, 60).astype(np.uint64)
    wa, wb = rng.uniform(1, 4, 60), rng.uniform(1, 4, 60)
    a, b = np.arange(0, 45), np.arange(15, 60)
    x, y = dict(zip(a, wa[a])), dict(zip(b, wb[b]))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
    places = 4000
    s = [minhash.signatures(np.zeros(len(k), np.int64), elements[k], w[k], 1, places)[0] for k, w in ((a, wa), (b, wb))]
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(400, 460)] + [(k, k + 1) for k in range(500, 560)] + [(None, 1), (7, 7)]
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_passages_go_and_the_rest_stays(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passages = ["\n".join(sentence(k) for k in ks) for ks in ((60,), (30, 31), (25, 3, 30), (12, 20, 22))]
    short = sentence(9)
    texts, hosts = {}, defaultdict(list)
    for i in range(60):
        lines = [sentence(rng.randint(5, 40)) for _ in range(rng.randint(2, 8))] + [short]
        if i % 3 == 0:
            p = passages[i // 3 % 4]
            at = rng.randint(0, len(lines) - 2)  # not beside the short line
            lines[at:at] = p.split("\n")
            hosts[p].append(i)
        texts[i] = "\n".join(lines)
    out = {r.doc_id: r for r in linechunks.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for p, ids in hosts.items():
        assert p in out[ids[0]].text
        for i in ids[1:]:
            assert out[i].n_words_removed == len(p.split()) and not any(line in out[i].text.split("\n") for line in p.split("\n"))
    clean = [i for i in texts if all(i not in ids[1:] for ids in hosts.values())]
    assert all(out[i].text == texts[i] and out[i].n_lines_removed == 0 for i in clean)


def test_warc_round_trip_and_salvage(spark, tmp_path):
    rows = [(i, f"http://h/{i}", b"<p>%d \x00\xff\r\n\r\nWARC/1.1\r\n" % (i // 2)) for i in range(40)] + [(90, None, None), (None, "http://x y\n", b"z")]
    path = str(tmp_path / "a")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(2), path, records_per_file=8)
    read = warc.read_warc(spark, path)
    assert warc.gaps(read).count() == 0
    got = {warc_id(r.record_id): r for r in warc.records(read).collect()}
    assert len(got) == len(rows)
    for i, url, payload in rows:
        first = None if i is None or i >= 40 or i % 2 == 0 else i - 1
        r = got[i]
        assert r.record_type == ("response" if first is None else "revisit") and warc_id(r.refers_to) == first
        assert r.payload_bytes == len(payload or b"")
        assert first is not None or bytes(r.payload) == (payload or b"")
    # damage: cut, overwritten and inserted bytes
    members = [gzip.compress(warc.record(i, "u", b"payload %d" % i, "", None).replace(b"WARC-Payload-Digest: sha1:\r\n", b"")) for i in range(6)]
    bad = bytearray(members[1])
    bad[20:30] = b"\x00" * 10
    data = b"junk" + members[0] + bytes(bad) + members[2] + members[3][:-9] + members[4] + b"\x1f\x8b\x08tail" + members[5][:12]
    found = list(warc.salvage(data))
    kept = [r["fields"]["warc-record-id"] for _, _, r, _ in found if r]
    assert [warc_id(k.strip("<>")) for k in kept] == [0, 2, 4]
    spans = sorted((s, e) for s, e, _, _ in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == z[0] for a, z in zip(spans, spans[1:]))
    plain = [warc.record(i, "u", b"p%d" % i, "", None).replace(b"WARC-Payload-Digest: sha1:\r\n", b"") for i in range(4)]
    wrong = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(plain[0] + wrong + plain[2] + plain[3][:-2]))
    assert [bool(r) for _, _, r, _ in found] == [True, False, True, False]


def warc_id(text):
    m = re.fullmatch(r"urn:kinledger:page:(-?\d+)", text or "")
    return int(m[1]) if m else None


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["\\", "\\b", "\\h", "### ", "</turn>", "<next/>", "</turn>\n", ": ", "\n", "a", "", "\u00e9", "### user: ", "\\\\n", "#### x", "</tur</turn>n>"]
    rows = [(c, t, rng.choice(["user", "assistant", "odd: role\\", "Assistant", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for c in range(40) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in made.collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")
        runs = 1 + sum(a[2] != b[2] for a, b in zip(mine, mine[1:]))
        assert r.formatted.count("</turn>\n") == runs


def test_equal_turns_go_by_what_they_say(spark):
    rows = [(1, 0, "b", "### x"), (1, 0, "b", "$ y"), (1, 0, "a:", "z"), (1, 0, "a", "\\\\"), (1, 0, "a", "</turn>"), (1, 0, "a", "</turn>")] + [(2, i, "user" if i % 700 else "assistant", f"t{i}") for i in range(3000)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == sorted((r[2], r[3]) for r in rows[:6])
    assert [t.text for t in got[2].turns] == [f"t{i}" for i in range(3000)] and got[2].loss == "".join(f"t{i}" for i in range(0, 3000, 700))


def test_automata_one_after_another(spark):
    from kinledger.llm import decontaminate

    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[:6]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(200) if i % 7 else None) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(rng.randint(3, 14))) for i in range(30)], "item_id long, text string")
    one, many = ({r.doc_id: r for r in decontaminate.find(docs, items, n=5, block_windows=k).collect()} for k in (10**6, 17))
    assert one == many and any(r.hit_words for r in one.values())


def test_all_links_of_a_page_count(spark):
    link = '<link rel=canonical href="{}">'
    rows = [(1, "http://a.org/1", link.format("http://x.org/") + "<p>" + link.format("http://q.net/es/2")), (2, "http://x.org/", "")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block"}


def test_block_reaches_aliases_and_allow_comes_first(spark):
    link = '<head><link href="{}" rel=canonical></head>'
    rows = [
        (1, "http://a.org/1", link.format("http://x.example.com/en/p")),  # alias of a blocked url
        (2, "http://b.org/2", link.format("http://a.org/1")),  # alias of an alias
        (3, "http://c.org/3", '<meta http-equiv="refresh" content="0; url=/4">'),
        (4, "http://c.org/4", ""),
        (5, "http://d.org/5", link.format("http://www.example.com/en/q")),  # alias of an allowed url
        (6, "http://WWW.d.net/es/6", link.format("http://d.org/5")),  # blocked itself
        (7, "http://q.com/7", link.format("http://b.org/2")),  # allowed itself
        (8, "nothing", link.format("http://a.org/1")),
        (9, "http://e.org/9#frag", None),
        (10, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://e.org/9", "http://f.net/fr/1")], "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, redirects=redirects).collect()}
    # 7 is an explicit allow in the component of 1 and 2, which therefore isn't blocked for them
    assert got == {
        1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("net/es/", "block"),
        7: ("com/", "allow"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "allow"),
    }
    without = {r.page_id: r.verdict for r in urlfilter.judge(pages.where("page_id <> 7")).collect()}
    assert without[1] == without[2] == "block" and without[9] == "allow"


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, f"s{min(int(rng.expovariate(0.5)), 6)}", " ".join("w" * rng.randint(1, 60))) for i in range(4000)]
    df = spark.createDataFrame([(i, s, t if i % 50 else None) for i, s, t in rows], "doc_id long, source string, text string")
    out = mixing.mix(df).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    total = sum(r["size"] for r in out)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-3 * total
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)
        assert v[0].target <= 2 * v[0].source_size + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def _by_hand(rows, odds=True):
    """Which rows of one source (id, words, target) get one copy more, in exact order; and their inclusion probabilities."""
    import hashlib

    size = {i: len(t.split()) for i, t in rows}
    rest, cut = 0.4 * sum(size.values()), sorted(size.values(), reverse=True)
    for c in sorted(set(cut), reverse=True):
        larger = sum(s for s in cut if s > c)
        theta = (rest - larger) / sum(s * s for s in cut if s <= c)
        if theta * c <= 1:
            break
    p = {i: 1.0 if s > c else theta * s for i, s in size.items()}
    u = {i: (int(hashlib.md5(f"mix-1:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i, t in rows}
    certain = {i for i in size if size[i] > c}
    order = sorted((i for i in size if i not in certain and size[i]), key=lambda i: u[i] / (1 - u[i]) / (p[i] / (1 - p[i]) if odds and p[i] < 1 else 1))
    left, taken = rest - larger, set()
    for i in order:
        if left < size[i] / 2:
            break
        taken.add(i)
        left -= size[i]
    return certain | taken, p


def test_pareto_odds_decide(spark):
    rng = random.Random(31)
    rows = [(i, " ".join("w" * min(int(rng.paretovariate(0.9)) + rng.randint(0, 3), 400))) for i in range(3000)]
    df = spark.createDataFrame([(i, "s", t) for i, t in rows], "doc_id long, source string, text string")
    got = {r.doc_id for r in mixing.mix(df, total=1.4, most=2.0).where("copies = 2").collect()}
    want, p = _by_hand(rows)
    assert got == want
    equal, _ = _by_hand(rows, odds=False)
    assert len(got ^ equal) > 100
    # over many seeds a document is drawn about as often as its probability says
    drawn, seeds = defaultdict(int), 5
    for k in range(seeds):
        for r in mixing.mix(df, total=1.4, seed=f"seed {k}").where("copies = 2").select("doc_id").collect():
            drawn[r.doc_id] += 1
    groups = defaultdict(list)
    for i, x in p.items():
        groups[min(int(x * 8), 7)].append(i)
    for ids in groups.values():
        if len(ids) >= 20:
            n, want = seeds * len(ids), sum(p[i] for i in ids) / len(ids)
            assert abs(sum(drawn[i] for i in ids) / n - want) < 4 * (want * (1 - want) / n) ** 0.5 + 0.01


def test_repeated_rows_meet_their_target(spark):
    words = lambda k: " ".join("w" * k)
    rows = [(None, "a", words(20)) for _ in range(400)] + [(None, "b", words(20) + f" {i}") for i in range(400)] + [(7, None, words(30))] * 50
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)).collect()
    assert len(out) == len(rows)
    for source in ("a", "b", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 31 and all(r.taken <= 2 * r["size"] for r in mine)
