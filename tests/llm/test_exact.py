import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup, license_scan, mix
from keyloom.llm.mph import PerfectHash

from .conftest import docs_frame


def test_perfect_hash_is_minimal_and_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        mph = PerfectHash.build(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(n))
        back, slots = PerfectHash.from_bytes(mph.to_bytes(digest=keys))
        assert (back.slots(keys) == mph.slots(keys)).all() and (slots["digest"] == keys).all()
    same = np.zeros((3, 32), dtype=np.uint8)
    same[:, 31] = [1, 2, 3]
    assert sorted(PerfectHash.build(same).slots(same).tolist()) == [0, 1, 2]


def want_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[bare], key=lambda g: (g[0], g[1], g[2] or 0))
        out.append((i, best[2], len(groups[bare]), i == best[2] and len(t or "") == -best[0], hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_exact_dedup_whatever_the_history(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for history in (F.pmod("doc_id", F.lit(2)) == 0, F.lit(True), F.lit(False)):
        got = exact_dedup.exact_dedup(odd_docs, history).collect()
        assert sorted(map(repr, map(tuple, got))) == want_groups(rows)
    assert exact_dedup.exact_dedup(no_docs, F.lit(True)).count() == 0


def waterfill(sizes, weights, budget):
    target, open_ = {}, dict(zip(sizes, weights))
    left = budget
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > 2 * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix(spark, odd_docs, no_docs):
    got = mix.mix(odd_docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mix.mix(odd_docs.repartition(5)).collect()))
    by = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        by[r["source"]] += r["size"]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target = waterfill({s: by[s] for s in order}, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(by.values()))
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
    assert mix.mix(no_docs).count() == 0
    many = docs_frame(spark, [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(2000)])
    rows = mix.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    # Each source leaves less than one document open; another may take what three left.
    assert all(abs(r["taken"] - r["target"]) <= 3 * 9 for r in rows), rows
    taken = mix.mix_documents(many).groupBy("doc_id").count()
    want = mix.mix(many).where("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("long").alias("count"))
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, want.collect())) and mix.mix_documents(many).columns == many.columns
    half = mix.mix_sizes(mix.document_sizes(many), budget=0.5)
    total = half.agg(F.sum("size"), F.sum(F.col("copies") * F.col("size"))).first()
    assert 0.5 * total[0] - 4 * 9 <= total[1] <= 0.5 * total[0]
    clash = many.withColumnsRenamed({"path": "copy", "digest": "copies", "blob": "mix_id"})
    assert mix.mix_documents(clash).columns == clash.columns and mix.mix_documents(no_docs).count() == 0
    nameless = docs_frame(spark, [(None, f"word {i}", "a") for i in range(50)])
    assert 70 <= mix.mix_documents(nameless).count() <= 75
    zero = docs_frame(spark, [(1, ""), (2, None)])
    assert [r["taken"] for r in mix.mix(zero).collect()] == [0, 0]


def test_word_count(odd_docs):
    for r in odd_docs.select("text", mix.word_count(F.col("text")).alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def brute_licenses(text):
    """Every run of segments against every template, without any bound or filter."""
    segs = [(k, license_scan._split(p)) for k, line in enumerate((text or "").split("\n")) for p in re.sub(r"([.!?;:])[ \t]+", "\\1\x01", line).split("\x01")]
    segs = [s for s in segs if s[1]]
    templates = {n: set(license_scan.template_bigrams(t)) for n, t in license_scan.TEMPLATES.items()}
    assert all(len(t) == len(license_scan._split(license_scan.TEMPLATES[n])) - 1 for n, t in templates.items())
    found = []
    for i in range(len(segs)):
        words = []
        for j in range(i, len(segs)):
            words = words + segs[j][1]
            g = set(license_scan.template_bigrams(" ".join(words)))
            if g and len(g) < 400:
                dice, name = min((-2 * len(g & t) / (len(g) + len(t)), n) for n, t in templates.items())
                if -dice >= 0.8:
                    found.append((-len(g & templates[name]), dice, i, j, name, len(g)))
    best = []
    for x in sorted(found):
        if not any(y[2] <= x[3] and x[2] <= y[3] for y in best):
            best.append(x)
    return sorted((segs[i][0], segs[j][0], name, round(-dice, 9), n) for _, dice, i, j, name, n in best)


def test_license_scan(spark, odd_docs, no_docs):
    t = license_scan.TEMPLATES
    wrap = lambda x, n: "\n".join(" ".join(x.split()[k : k + n]) for k in range(0, len(x.split()), n))
    prose = "\n".join(f"a line of other words number {k}" for k in range(60))
    texts = [
        "Released under the MIT License.",
        "x\nreleased UNDER the (MIT) license\ny",
        f"{prose}\n{wrap(t['MIT-text'], 9)}\n{prose}",
        f"{prose} Some words. {t['GPL-3.0-header']} More words. {prose}",
        f"Copyright 2020 A Person\n{wrap(t['BSD-3-Clause-text'], 12)}\n{wrap(t['Apache-2.0-header'], 7)}",
        t["MIT"] + "\n" + t["MIT"] + " " + t["CC-BY-4.0"],
        "released under the sun", None, "a", "", " \n ",
    ]
    texts += [" ".join(x.split()[: max(2, len(x.split()) * k // 10)]) for x in t.values() for k in (6, 7, 8, 9, 10)]
    rows = license_scan.license_scan(docs_frame(spark, list(enumerate(texts)))).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(tuple(r)[1:])
    for i, text in enumerate(texts):
        assert sorted(got[i]) == brute_licenses(text), (i, text)
    assert [x[2] for x in got[2]] == ["MIT-text"] and [x[2] for x in got[3]] == ["GPL-3.0-header"] and {x[2] for x in got[4]} >= {"BSD-3-Clause-text", "Apache-2.0-header"} and len(got[5]) == 3
    assert license_scan.license_scan(no_docs).count() == 0 and license_scan.license_scan(odd_docs).count() == 0
    twice = docs_frame(spark, [(None, texts[0]), (None, texts[0])])
    assert license_scan.license_scan(twice).count() == 2
