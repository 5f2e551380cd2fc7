"""The pipeline on a corpus with planted cases, stage by stage and as a whole."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from kinledger.llm.common import written


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(common) if rng.random() < 0.7 else word() for _ in range(rng.randint(12, 25))) for _ in range(n))
    items = [" ".join(word() for _ in range(25)) for _ in range(5)] + ["tiny item"]
    passage = "\n".join(" ".join(word() for _ in range(28)) for _ in range(2))
    rows, labels, kind = [], [], defaultdict(set)
    for i in range(600):
        lines, toxic = text(rng.randint(4, 9)).split("\n"), 0
        if i % 5 == 0:
            toxic = 1
            lines = [" ".join(w if rng.random() > 0.08 else rng.choice(("wretchfool", "wretchling", "wretched")) for w in line.split(" ")) for line in lines]
            lines[0] += " wretchfool wretched"
            kind["toxic"].add(i)
        elif i % 50 == 1:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage.split("\n")
            kind["passage"].add(i)
        elif i % 50 == 2:
            lines[1] += " " + items[i % 5].upper().replace(" ", ", ")
            kind["leak"].add(i)
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, 1, toxic))
    for i in range(600, 640):  # copies with a word changed in each line: no line repeats, few shingles differ
        of = rows[i - 600 + 3][1] if (i - 600 + 3) % 5 else rows[4][1]
        one = " ".join(of.split("\n")).split(" ")
        one[len(one) // 2] = "changed"
        rows.append((i, " ".join(one), "en", "s1", 0))
    d = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r for r in rows}, kind, passage


def test_stages_and_run(spark, planted):
    d, rows, kind, passage = planted
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), "test")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(rows) - kind["toxic"]
    assert not kind["toxic"] & set(seen["toxicity"])
    assert len(clean - set(seen["toxicity"])) <= 0.02 * len(clean)

    first, *rest = sorted(kind["passage"] & set(seen["toxicity"]))
    lines = seen["line_dedup"]
    assert passage in lines[first].text
    for i in rest:
        assert lines[i].text == rows[i][1].replace(passage + "\n", "").replace("\n" + passage, "") and lines[i].n_chars == len(lines[i].text)
    assert all(lines[i].text == rows[i][1] for i in lines if i not in rest)

    kept = set(seen["near_dedup"])
    gone = set(lines) - kept
    assert gone and all(i >= 600 for i in gone)
    originals = {i: (i - 600 + 3 if (i - 600 + 3) % 5 else 4) for i in range(600, 640)}
    assert gone == {i for i in lines if i >= 600 and originals[i] in kept} | {i for i in lines if i >= 600 and any(j in kept and j < i and originals[j] == originals[i] for j in range(600, i))}

    assert set(seen["decontamination"]) == kept - kind["leak"]

    mix = seen["mixing"].values()
    assert all(0 < r.copies <= 2 and r.taken == r.copies * r["size"] for r in mix)
    taken = defaultdict(int)
    for r in mix:
        taken[r.source] += r.taken
    for r in mix:
        assert abs(taken[r.source] - r.target) <= max(x["size"] for x in mix)
    whole = {r.doc_id: (r.text, r.copies) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {r.doc_id: (r.text, r.copies) for r in mix}
