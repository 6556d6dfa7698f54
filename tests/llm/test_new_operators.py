"""Filter audit, conversation trie and SimHash classes: DuckDB and brute force on whole small tables, planted cases, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash

from orbitframe.llm import audit, simhash, tries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, mask string, part string, n string, same string, f string"
TALK = "conv_id long, turn long, role string, text string, p string, name string, d string, total string"


def plain(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    rows = con.execute(sql).fetchall()
    names = [x[0] for x in con.execute(f"DESCRIBE {sql}").fetchall()]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


def written(df, folder):
    df.coalesce(2).write.parquet(str(folder))
    return f"{folder}/*.parquet"


def odd_docs(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    huge = "Aa#" * 1_000_000
    rows = [(1, None, None), (2, "", "en"), (3, "one two", "en"), (3, "one two", "en"), (5, "one two", "de"), (4, long, "en"), (9, long, None), (None, "one two", "en"), (None, "no id", None), (6, " \t\n\x0b", "en"), (7, huge, "fr"), (-8, huge, "fr")]
    return spark.createDataFrame([(i, t, lang, "a", "x", "x", "x", "x", "x") for i, t, lang in rows], DOCS)


def test_audit_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = plain(audit.report(audit.cells(docs, labels)))
    assert got == duck(audit.ORACLE, documents=written(docs, tmp_path / "d"), labels=written(labels, tmp_path / "l"))
    assert len(got) == 4 * 600  # '', de, en, fr


def test_audit_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows, least = docs.collect(), {}
    for r in rows:
        least[r["text"] or ""] = min(least.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    fails = {}
    for r in rows:
        text = r["text"] or ""
        words = [w.decode() for w in text.encode().split()]
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": r["doc_id"] > least[text]}
        fails[r["doc_id"]] = (r["lang"] or "", {k for k, v in bad.items() if v})
    want = defaultdict(lambda: [0] * 6)
    for i, (part, bad) in fails.items():
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                earlier = bad & set(order[: step - 1])
                removed = not earlier and name in bad
                label = labels.get(i)
                for k, yes in enumerate((not earlier and not removed, removed, bool(earlier) and name in bad, bad == {name}, removed and label and label["quality"] == 1, removed and label and label["toxic"] == 1)):
                    want[part, "".join(order), step][k] += bool(yes)
    shapley = defaultdict(int)
    for (part, order, step), v in want.items():
        shapley[part, order[step - 1]] += v[1]
    got = audit.op11_audit(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == want[key]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def trie_by_hand(rows):
    """Every node by walking every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in sorted(talks):
        h = zlib.crc32(str(c).encode()) % 4
        whole = talks.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + talks[c][h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append((c, d == len(whole)))
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        value = (len(members) - 1) * len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += value
            leaves[path[:d]] += kids[path] == 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c, end in members if end)
        up = nodes[path[:-1]][0][0] if path else None
        out.append({"conv_id": members[0][0], "depth": len(path), "parent_conv_id": up, "n_convs": len(members), "n_children": kids[path], "n_leaves": leaves[path], "saved_tokens": saved[path], "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()})
    return sorted((tuple(r[k] for k in sorted(r)) for r in out), key=str)


def talk(rng, convs, most, words):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_hand(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = talk(rng, range(-25, 90), 9, ["a", "b c"])
    rows += [(300, t, "user", f"x {t % 7}") for t in range(70)] + [(c, t, "user", f"x {t % 7}") for c in (307, 308, 311) for t in range(66 if c == 311 else 70)]
    rows += [(500 + i, t, "user", "same") for i in range(60) for t in range(4)]  # copies
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "p", "n", "d", "t") for r in rows], TALK)
    got = plain(tries.trie(df))
    assert got == trie_by_hand(rows)
    assert got == duck(tries.ORACLE, conversations=written(df, tmp_path / "c"))


def test_trie_blocks_of_chains_and_ids(spark, monkeypatch):
    """Chains and id lists longer than a block."""
    monkeypatch.setattr(tries, "SPAN", 4)
    rows = [(c, t, "user", f"{min(c, 3)} {t}" if t > 5 else "same words") for c in (20, 21, 22, 23) for t in range(20)]
    rows += [(1000 + i, 0, "user", "hello") for i in range(500)]
    assert plain(tries.trie(spark.createDataFrame([(*r, "p", "n", "d", "t") for r in rows], TALK))) == trie_by_hand(rows)


def test_trie_long_id_lists():
    import pandas as pd

    rows = [pd.DataFrame({"d": [1] * 25_000, "name": [7] * 25_000, "conv_id": range(25_000)}), pd.DataFrame({"d": [1, 2], "name": [7, 0], "conv_id": [30_000, -5]})]
    done = pd.concat(tries._digested(tries._joined(iter(rows))))
    ids = ",".join(map(str, [*range(25_000), 30_000]))
    assert done.values.tolist() == [[1, 7, hashlib.sha256(ids.encode()).hexdigest()], [2, 0, hashlib.sha256(b"-5").hexdigest()]]


def test_trie_odd_rows(spark, tmp_path):
    long = "word " * 200_000
    rows = [(1, None, None, None), (1, None, None, None), (1, 2, "user", "x"), (None, 1, "user", "lost"), (5, 0, "user", ""), (20, 3, "user", long), (20, 3, "user", long), (20, None, "a", "b"), (39, 1, "b", "z"), (39, 1, "b", "y"), (39, 1, "a", "z")]
    df = spark.createDataFrame([(*r, "p", "n", "d", "t") for r in rows], TALK)
    got = plain(tries.trie(df))
    assert got == trie_by_hand(rows) == duck(tries.ORACLE, conversations=written(df, tmp_path / "c"))
    assert tries.trie(df.limit(0)).collect() == []


def test_trie_only_root(spark):
    """Own turns are all within the first h and there is no donor."""
    c = next(c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone")]
    got = plain(tries.trie(spark.createDataFrame([(*r, "p", "n", "d", "t") for r in rows], TALK)))
    assert got == trie_by_hand(rows) and len(got) == 1


def shingled(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Component of each distinct fingerprint by comparing all pairs."""
    f = np.array(sorted(set(prints)), np.uint64)
    up = list(range(len(f)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            up[b] = a
    return {int(x): root(i) for i, x in enumerate(f)}


def expected(rows):
    prints = [(i, shingled(t or "")) for i, t in rows]
    comp = linked([f for _, f in prints])
    least = {}
    for i, f in prints:
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    return sorted((str(i), f"{f:016x}", least.get(comp[f])) for i, f in prints)


def found(df):
    return sorted((str(r["doc_id"]), f"{r['f'] & (1 << 64) - 1:016x}", r["component_id"]) for r in df.collect())


def test_simhash_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op13_simhash(spark, "/root/testdata/sf0.01").collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == expected(rows)
    assert len({r["component_id"] for r in got}) < len(got) - 50


def test_simhash_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(simhash.classes(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert simhash.classes(docs.limit(0)).collect() == []


def test_masks_cover_every_pair():
    rng = np.random.default_rng(3)
    own = np.array(simhash.masks(), np.uint64)
    assert len(own) == 31
    for _ in range(5000):
        differ = np.uint64(sum(1 << int(i) for i in rng.choice(64, 4, replace=False)))
        assert ((own & differ) == 0).any()


@pytest.mark.parametrize("small", [2, 16, 1024])
def test_links_of_crowded_buckets(spark, small):
    """Chains and clouds of fingerprints that differ in few bits, by lists and by midpoints, against all pairs."""
    rng = random.Random(small)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "f long")
    out = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, small=small).collect()]
    want, up = linked(prints), {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in out:
        up[root(a)] = root(b)
    groups, asked = defaultdict(set), defaultdict(set)
    for x in prints:
        groups[root(x)].add(x)
        asked[want[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, asked.values()))


def test_toxicity_learns_from_every_label(spark):
    """A word that stands in toxic texts alone, of which no class of 2000 rows has most, is known; so are texts of more than 4000 words. Many shards
    learn what one does."""
    from pyspark.sql import functions as F

    from orbitframe.llm import toxicity

    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 10 == 0, "vile").otherwise("kind"), F.repeat(F.lit(" the plain words"), 5), F.when(F.col("id") % 100 == 0, F.repeat(F.lit(" more of them"), 1500)).otherwise("")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    rows, counts = toxicity.labelled(docs, labels, "toxic", F.lit(True))
    assert rows.count() == n and counts == {0: n - n // 10, 1: n // 10}
    p = toxicity.Params(shard_rows=700)
    df, texts = toxicity.counted(toxicity.encode(rows, p).coalesce(4), p)
    assert list(texts) == [n - n // 10, n // 10] and df.max() == n - n // 10
    for own in (p, toxicity.Params()):
        model = toxicity.fit(docs, labels, F.lit(True), own)
        assert toxicity.score(docs, model).join(labels, "doc_id").where((F.col("score") >= 0.3) != (F.col("toxic") == 1)).count() == 0


def test_toxicity_sends_sums_alone_and_stages_less_than_the_text(spark, monkeypatch):
    """The driver gets one sum of the network's size a round, not what each shard has learnt; encoded rows take less room than their texts."""
    import numpy as np
    from pyspark.sql import functions as F

    from orbitframe.llm import toxicity

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 10 == 0, "vile").otherwise("kind"), *(F.concat(F.lit(" word"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3000))) for k in range(60))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    p = toxicity.Params(shard_rows=700)
    rows = toxicity.encode(toxicity.labelled(docs, labels, "toxic", F.lit(True))[0].repartition(8), p)
    room = rows.select(F.sum(F.length("words") + F.length("grams"))).first()[0]
    assert room < docs.select(F.sum(F.length("text"))).first()[0]
    sent, summed = [], toxicity._summed
    monkeypatch.setattr(toxicity, "_summed", lambda *a: sent.append(x := summed(*a)) or x)
    nets = []
    for shards in (1, 8):
        train, net = rows.coalesce(shards), toxicity.Network(p)
        net.start(*toxicity.counted(train, p, shards))
        net.begin()
        toxicity.learn(train, net, np.ones(2, np.float32), 1, 0, shards)
        nets.append(net)
    size = [sum(len(a) + len(v) for _, a, v in x) for x in sent]
    assert size[2] == size[0] and size[3] < 1.2 * size[1]
    assert nets[0].step > nets[1].step > 0 and all(np.isfinite(v).all() for net in nets for v in net.w.values())


def test_toxicity_table_rows():
    from orbitframe.llm import toxicity

    words = [w.encode() for w in ("a", "abc", "abcd", "abcdefg", "abcdefgh", "straße", "großartigkeit", "abcdefü", "abcdefgü", "ñandú", "x" * 50)] + [b"abcdefg\xff", b"\xc3abcdefgh"]
    assert toxicity.table_rows(words, 18).tolist() == [toxicity.rows_of(w, 18) for w in words]
