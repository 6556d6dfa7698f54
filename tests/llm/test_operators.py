"""Corpus operators: brute force on the smallest table, and defined results for nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.llm import decontaminate, fingerprints, html, licenses, mixing, neardup, quality, registry, scoring, substrings, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, h string, t string"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and repeated rows, one long text, columns with names that operators use inside."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (4, long, "en", "b"), (5, long, "en", None), (None, "no id here at all", None, "b"), (6, " \t\n", "en", "b")]
    return spark.createDataFrame([(*r, 0, "x", "y", "z") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substrings_brute_force(spark, texts):
    first, words = {}, {i: t.encode().split() for i, t in texts}
    for i, w in words.items():
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.queries()["op7_substrings"](spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values())


def test_substrings_odd(odd, empty):
    got = substrings.repeats(odd).collect()
    assert len(got) == 8 and {r["doc_id"]: r["n_removed"] for r in got}[5] == 3000 and {r["doc_id"]: r["n_removed"] for r in got}[4] == 0
    out = substrings.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == 8 and out.where("doc_id = 5").first()["text"] == ""
    assert substrings.repeats(empty).count() == 0


def test_neardup_brute_force(spark, texts):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for e in s:
            holders[e].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for e in s for j in holders[e] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in registry.queries()["op9_neardup"](spark, SF).collect()}
    assert got == {i: root(i) for i in sets} and len(set(got.values())) < len(got)


def test_neardup_odd(odd, empty):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, None: None}
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_one(odd).collect()) == [0, 1, 2, 3, 4, 6]
    assert neardup.classes(empty).count() == 0


def test_neardup_single_links(spark):
    """Pairs at exactly 0.8, all of whose common elements others have as well, at most at 0.74: one link each, which hardly any leader has part in."""
    core, rows = [f"c{k}" for k in range(80)], []
    for i in range(256):
        both = core + [f"u{i // 16}x{k}" for k in range(4)] + ["s0", "s1", "s2", "s3"] + [f"v{i % 16}x{k}" for k in range(4)]
        rows += [(2 * i + j, " ".join(both + [f"o{i}x{j}x{k}" for k in range(11)])) for j in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_neardup_repeated_shingles(spark):
    """Pairs that are alike as sets though one of the two repeats a passage many times: nearly all are found."""
    rows, alike = [], 0
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(150)]
        part, other = words[140:], [f"o{i}x{k}" for k in range(12)]
        pair = words + part * (5 + i), words + other
        rows += [(2 * i + j, " ".join(w)) for j, w in enumerate(pair)]
        a, b = ({tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in pair)
        alike += len(a & b) >= 0.8 * len(a | b)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert alike == 60 and sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 59


def test_probability_jaccard():
    """Registers agree with the probability Jaccard of the weights."""
    r = np.random.default_rng(1)
    e = np.sort(r.integers(0, 1 << 62, 300).astype(np.uint64))
    a, b = r.uniform(1, 3, 300), r.uniform(1, 3, 300)
    sig = neardup.signatures(np.concatenate((e, e)), np.concatenate((a, b)), np.array([0, 300, 600]), 4096)
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(300))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_mixing(spark, odd, empty):
    got = registry.queries()["op6_mixing"](spark, SF).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((by.taken - by.target).abs() <= by["size"]).all()
    assert mixing.mix(odd).count() == 8 and mixing.sample(odd).columns == odd.columns and mixing.mix(empty).count() == 0


def test_mixing_with_many_sources(spark, odd, monkeypatch):
    """Thresholds that are not broadcast are joined by salted sources: same mix."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = [sorted(map(str, mixing.mix(d).collect())) for d in (docs, odd)]
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert one == [sorted(map(str, mixing.mix(d).collect())) for d in (docs, odd)]


def test_licenses(spark, texts, odd, empty):
    upper = str.maketrans(licenses.UPPER, licenses.LOWER)
    want = {}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(upper))
        at = sorted((p, k) for k, b in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(b.split())] == b.split())
        want[i] = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at})))
    got = registry.queries()["op4_licenses"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got} == want
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    text = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. Mit License"), (2, "nc by cc 4 0")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(text).collect()} == {1: "cc-by-nc,mit", 2: ""}
    assert licenses.scan(odd).count() == 8 and licenses.scan(empty).count() == 0


def test_licenses_common_notice_and_all_templates(spark):
    """A notice in a third of the rows keeps its label, and so does each of many licence texts in one file."""
    rows = [(i, f"some words number {i} " + ("licensed under cc by nc 4 0" if i % 3 == 0 else "and no notice")) for i in range(90)]
    rows += [(100 + k, f"file {k} {text} end") for k, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows.append((200, " ".join(f"part {k} {text} end" for k, (_, text, _) in enumerate(licenses.TEMPLATES))))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (["cc-by-nc"] if i % 3 == 0 else [""]) for i in range(90))
    assert all(label in got[100 + k] for k, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert set(got[200]) == {label for label, _, _ in licenses.TEMPLATES}


def test_licenses_brute_force(spark, texts):
    """Labels and scores by the definition, over texts with notices, gaps, cut notices and none."""
    notices = [t for _, t, _ in licenses.TEMPLATES]
    rows = [(i, t) for i, t in texts[:60]] + [(1000 + k, "a b c " + t + " d") for k, t in enumerate(notices)]
    for k, (_, t, phrase) in enumerate(licenses.TEMPLATES):
        w, after = t.split(), len(t[: t.index(phrase)].split()) + len(phrase.split())
        gap = after if after < len(w) else after // 3  # not inside the phrase
        rows += [(2000 + k, " ".join(w[:gap] + ["so", "to", "say"] + w[gap:])), (3000 + k, " ".join(w[: len(w) // 2])), (4000 + k, " ".join(w[::-1]))]
    words = {i: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", t.lower()) for i, t in rows}
    counts = Counter(w for x in words.values() for w in set(x) & set(licenses.VOCABULARY))
    want = {}
    for i, w in words.items():
        labels, best = {k for k, b in licenses.BASE.items() if f" {b} " in f" {' '.join(w)} "}, 0.0
        best = 0.5 if labels else 0.0
        for label, text, phrase in licenses.TEMPLATES:
            t, rare, n, must = text.split(), licenses.rarest(counts, text), licenses.slack(text), phrase.split()
            start = next(k for k in range(len(t)) if t[k : k + len(must)] == must)
            votes = [(p - j, x) for p, x in enumerate(w) if x in rare for j in range(len(t)) if t[j] == x]
            votes += [(p - start, None) for p in range(len(w)) if w[p : p + len(must)] == must]
            bands = defaultdict(set)
            for o, x in votes:
                for g in (0, 1):
                    bands[g, (o + g * n) // (2 * n)].add(x)
            hits = [len(b - {None}) / len(rare) for b in bands.values() if None in b]
            if max(hits, default=0) >= 0.5:
                labels, best = labels | {label}, max(best, *hits)
        want[i] = (",".join(sorted(labels)), round(best, 9))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert all(licenses.TEMPLATES[k][0] in got[2000 + k][0].split(",") for k in range(len(notices)) if len(notices[k].split()) > 12)  # inserted words do no harm


def test_quality_votes_brute_force(spark):
    """A score is the similarity-weighted vote of the nearest labelled vectors, whatever the blocks."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()}
    cache = quality.WordHash()
    for r in docs.where("doc_id % 29 = 0").collect():
        z = m.project(quality.features([(r["text"] or "").encode()], cache, m.params))[0].astype(float)
        cos = sorted(((float(z @ v), k) for k, v in enumerate(m.vectors.astype(float))), reverse=True)[: m.params.neighbours]
        vote = [(max(c, 1e-3) ** 8 * m.weights[k], m.labels[k]) for c, k in cos]
        assert abs(got[r["doc_id"]] - sum(v * y for v, y in vote) / sum(v for v, _ in vote)) < 1e-3


def test_scoring(spark, texts, odd, empty):
    c, ends = Counter(), 0
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t.encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    got = registry.queries()["op5_scoring"](spark, SF).collect()
    by = {r["doc_id"]: r for r in got}
    for i, t in texts:
        w = t.encode().lower().split()
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert abs(by[i]["base_score"] - want) < 1e-6 and by[i]["n_known"] == sum(c[x] > 0 for x in w) + 1 and by[i]["train_tokens"] == n
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    p = scoring.Params(rounds=1)
    assert scoring.score(odd, F.lit(False), p).where("score is null or score > 0").count() == 0 and scoring.score(empty, F.lit(False), p).count() == 0


def test_scoring_sums_to_one():
    """Of all targets and the class of other words, in any context."""
    p = scoring.Params(branch=3, table_rows=(64, 64, 64))
    model = scoring.Model(p, np.arange(20.0), 7.0)
    model.w = [np.random.default_rng(k).normal(size=w.shape).astype(np.float32) for k, w in enumerate(model.w)]
    t = np.arange(1, p.size + 2)
    for one, two in ((0, 0), (5, 2), (p.size + 9, 1)):
        assert abs(np.exp(model.log_probs(t, np.full(len(t), one), np.full(len(t), two)).astype(float)).sum() - 1) < 1e-4


def test_scoring_starts_at_the_unigram_and_follows_the_gradient():
    """Without features a target has its add-one share; one step changes weights as the numeric gradient of the log likelihood says."""
    p = scoring.Params(branch=3, table_rows=(64, 64, 64), rate=1e-3, decay=0.0)
    model = scoring.Model(p, np.arange(27.0), 7.0)
    t, one, two = np.array([4, 4, 28, 9]), np.array([0, 3, 3, 4]), np.array([0, 0, 3, 4])
    share = np.append(np.arange(27.0) + 1, 8.0)
    assert np.allclose(model.log_probs(t, one, two), np.log(share[np.minimum(t, 28) - 1] / share.sum()), atol=1e-5)
    before, squares = model.log_probs(t, one, two).astype(float).sum(), [np.full(len(w), 1e6, np.float32) for w in model.w]
    old = [w.copy() for w in model.w]
    model.learn(t, one, two, squares)
    slope = sum(((w - o).astype(float) ** 2).sum() for w, o in zip(model.w, old, strict=True)) / (p.rate / 1e3)
    for w, o in zip(model.w, old, strict=True):
        w[:] = o + (w - o) * 1e5
    gained = model.log_probs(t, one, two).astype(float).sum() - before
    assert 0 < gained and abs(gained / (slope * 1e5) - 1) < 0.2


def test_scoring_odd_values(spark, odd, empty):
    """Repeated rows score alike, a null text as an empty one; without training rows every count is 0."""
    got = {(r["doc_id"], r["n_tokens"]): r for r in scoring.score(odd, F.lit(False), scoring.Params(rounds=1)).collect()}
    assert got[1, 1]["score"] == got[2, 1]["score"] and got[3, 3]["n_known"] == 3 and got[None, 6]["held_out"] is False
    none = scoring.score(odd, F.lit(True)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0} and all(r["base_score"] == 0 for r in none)


def test_fingerprints(spark, texts, odd, empty):
    got = {r["doc_id"]: r for r in registry.queries()["op8_fingerprints"](spark, SF).collect()}
    down, prints = texts[::-1], {}
    for k, (i, t) in enumerate(down):
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + down[(k + 1) % len(down)][1][:half]).encode()).hexdigest()
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert sum(r["near_edited"] for r in got.values()) > sum(r["near_next"] for r in got.values())
    band = spark.createDataFrame([("one",), ("two",)], "w string").select(F.xxhash64("w").alias("h"))
    assert fingerprints.edits(odd, band).count() == 8 and fingerprints.edits(empty, band.limit(0)).count() == 0


def test_fingerprints_brute_force(spark, texts, monkeypatch):
    """The band, each subset's hash and the likeness, by the definition; the same where the band is joined."""
    import xxhash

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def term(w):
        return signed(xxhash.xxh64_intdigest(w.encode(), 42))

    def all_of(hashes):  # Spark hashes an array by using each element's hash as the next one's seed
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest((h & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return seed

    def words(t):
        return set(re.split(fingerprints.BREAK, t.lower())) - {""}

    def fingerprint(t):
        every = {term(w) for w in words(t)}
        own = sorted(every & band) or sorted(every)
        parts = []
        for shift, mask, value in fingerprints.subsets():
            part = [h for h in own if ((h & (1 << 64) - 1) >> shift) & mask == value]
            parts.append(f"{all_of(part) & 0xFFFFFF:x}" if part else "")
        return ("" if every & band else "=") + "-".join(parts)

    def likeness(a, b):
        if a == b:
            return 1.0
        if a.startswith("=") != b.startswith("="):
            return 0.0
        x, y, n, out = a.lstrip("=").split("-"), b.lstrip("=").split("-"), fingerprints.PER_DENSITY, 0.0
        for k in range(4):
            p, q = x[k * n : k * n + n], y[k * n : k * n + n]
            either = sum(i != "" or j != "" for i, j in zip(p, q, strict=True))
            if k == 0 and either or min(sum(i != "" for i in p), sum(j != "" for j in q)) * 2 >= n:
                out = sum(i == j != "" for i, j in zip(p, q, strict=True)) / either
        return out

    df = Counter(w for _, t in texts for w in words(t))
    band = {term(w) for w, n in df.items() if max(2, 0.0025 * len(texts)) <= n <= 0.05 * len(texts)}
    down = texts[::-1]
    want = {}
    for k, (i, t) in enumerate(down):
        half, after = len(t) // 2, down[(k + 1) % len(down)][1]
        a, b, c = fingerprint(t), fingerprint(t[: len(t) - half] + after[:half]), fingerprint(after)
        want[i] = (a, b, likeness(a, b), likeness(a, c))
    columns = ["fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in registry.queries()["op8_fingerprints"](spark, SF).collect()}
    assert got == want
    monkeypatch.setattr(fingerprints, "MOST_TERMS", 0)
    assert got == {r["doc_id"]: tuple(r[c] for c in columns) for r in registry.queries()["op8_fingerprints"](spark, SF).collect()}


def test_decontaminate(spark, odd, empty):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in (r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and len(got - want) <= 2
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontaminate_hot_item(spark, texts):
    """An item in a third of the rows, some of them with every seventh word of its beginning replaced: found in each, however common its words."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item, text = bench.orderBy("item_id").select("item_id", "text").first()
    words = text.split()
    other = " ".join(w if k % 7 or k > 0.7 * len(words) else f"instead{k}" for k, w in enumerate(words))
    rows = [(i, t + " " + (other if k % 12 == 0 else text) if k % 3 == 0 else t) for k, (i, t) in enumerate(texts)]
    got = {r["doc_id"] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect() if r["item_id"] == item}
    assert {i for k, (i, _) in enumerate(texts) if k % 3 == 0} <= got and len(got) < 0.4 * len(texts)


@pytest.mark.parametrize("name, label, module", [("op1_quality", "quality", quality), ("op10_toxicity", "toxic", toxicity)])
def test_classifiers(spark, odd, empty, name, label, module):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.queries()[name](spark, sf)
    assert got.count() == 1000
    rows = got.join(labels, "doc_id").select("held_out", "score", label).collect()
    one, zero = ([r["score"] for r in rows if r["held_out"] and r[label] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    assert auc > (0.9 if label == "quality" else 0.7)
    none = module.fit(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in module.score(odd, none).collect()} == {0.0}
    model = module.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels, F.lit(True))
    assert module.score(odd, model).where("score between 0 and 1").count() == 8 and module.score(empty, model).count() == 0


def test_html_wrappers():
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T{0}</h1><p>Share this</p><p>Body&nbsp;{0} &amp; more\n text<p>{1}</article><div class='comments'>No</div><footer>F</footer>"
    out, wrapper = html.extract([page.format(k, "x " * 40 + str(k)) for k in range(4)])
    assert out[1] == "T1\nShare this\nBody 1 & more text\n" + "x " * 40 + "1"
    assert "+" in html.expression(wrapper) and "#PCDATA" in html.expression(wrapper)
    assert html.extract([""])[0] == [""] and html.extract(["<div>plain<br>text</div><script>var a='</p>'</script>"])[0] == ["plain text"]


def test_html_hard_markup():
    """Deep, unclosed and long markup is read whole, in time that grows with its length."""
    import time

    began = time.time()
    assert html.extract(["<div>" * 1500 + "deep" + "</div>" * 1500] * 3)[0] == ["deep"] * 3
    assert html.extract(["<p>a" + "<a " * 300_000])[0] == ["a"]
    assert html.extract(["<p>a</p>" + '<a x="' * 100_000])[0] == ["a"]
    text = html.extract([f"<article>{''.join(f'<h2>t{i}</h2><p>b{i}</p>' for i in range(10_000))}</article>", "<article><h2>x</h2><p>y</p></article>", "<article><p>z</p></article>"])[0]
    assert text[0].count("\n") == 19_999 and text[1:] == ["x\ny", "z"]
    mixed = np.random.default_rng(1).choice(["h2", "p", "ul", "pre", "div", "h3"], (2, 5000))
    for tags, got in zip(mixed, html.extract(["".join(f"<{t}>{i}</{t}>" for i, t in enumerate(row)) for row in mixed])[0], strict=True):
        assert got.split("\n") == [str(i) for i in range(len(tags))]
    assert time.time() - began < 60


def test_html_formulas_are_text():
    """A formula belongs to the line that it stands in, without its source; a canvas or object stands for its own text."""
    page = "<article><p>Area <math><mi>x</mi><mo>=</mo><msup><mn>3</mn><mn>2</mn></msup><annotation encoding='TeX'>x=3^2</annotation></math> holds.</p><p>See <object data=a.pdf><b>the paper</b></object> or <canvas>a plot</canvas>.</p></article>"
    assert html.extract([page])[0] == ["Area x=32 holds.\nSee the paper or a plot."]
    assert html.extract(["<p>a <math>x = 3"])[0] == ["a x = 3"]


def test_html_attributes():
    """Only whole names count: title, data-id and width are none of class, id, role, hidden."""
    page = '<article><p title="hidden gems">Text</p><p data-id="share">B</p><p width="3">C</p><p id=share-1>no</p><p CLASS=\'x AD\'>no</p><p hidden>no</p><p aria-hidden="true">no</p></article>'
    assert html.extract([page])[0] == ["Text\nB\nC"]


def test_html_the_wrapper_decides():
    """What is the same on all pages of a host is template text; a region needs its share of the slots; one page alone has no template."""
    page = "<body><p class=x>Buy now</p><div class=main><h1>Title {0}</h1><p>Body {0} of some length that goes on and on and on and on, as the text of {0} does</p></div><article class=teaser>{0}</article><pre>Imprint of the house</pre></body>"
    pages = [page.format(k) for k in ("one", "two", "three", "four")]
    together, alone = html.extract(pages)[0], html.extract(pages[:1])[0]
    assert together[1] == "Title two\nBody two of some length that goes on and on and on and on, as the text of two does\ntwo"
    assert alone == ["Buy now\nTitle one\nBody one of some length that goes on and on and on and on, as the text of one does\none\nImprint of the house"]
    same = html.extract(["<article><p>All the same</p></article><i>%d</i>" % k for k in range(4)])[0]
    assert same == ["All the same"] * 4  # most of the text: copies, no template


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/b", "<p>hi", "y"), (2, "http://a/b", "<p>hi", "y")], "page_id long, url string, html string, host string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.main_texts(df).collect()) == [(1, "", 0), (2, "hi", 2), (2, "hi", 2)]
    assert html.main_texts(df.limit(0)).count() == 0 and html.wrappers(df).count() == 2


def test_html_groups_do_not_depend_on_how_counts_travel(spark, monkeypatch):
    """Crowded hosts beyond the bound of the broadcast are joined by a shuffle: same groups."""
    from orbitframe.llm import html

    rows = [(i, f"http://h{i % 3 if i < 30 else i}.org/{i}", f"<p>page {i}</p>") for i in range(40)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted((str(r["page_id"]), r["host"], r["part"]) for r in html.grouped(pages, 4).collect())
    monkeypatch.setattr(html, "MOST_BROADCAST", 0)
    assert one == sorted((str(r["page_id"]), r["host"], r["part"]) for r in html.grouped(pages, 4).collect())
    assert len(one) == 41 and len({p for _, h, p in one if h == "h0.org"}) > 1
