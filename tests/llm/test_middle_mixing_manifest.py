"""Fill-in-middle, source mixing and Merkle manifests against plain Python, on small fixtures and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import manifest, middle, mixing, order

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", None, " ", "a", "\n\n", "a\n\n\nb  c", " lead and trail ", "tab\t and\n newline \n", "😀 é 漢字 　 wide", "x" * 3000, "ab " * 4000, "a <P> b", "<S", "x <M>", "\x00 null\x1c sep", "<P", "> <"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, "s%d" % (i % 4), i, "clash", 1) for i, t in enumerate(ODD)]
    rows += [(3, "a", "de", None, None, None, None), (3, "a", "de", None, None, None, None), (3, "other text", "de", None, 4, None, None), (None, "no id", None, "s", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, position long").cache()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11 --------------------------------------------------------------------------------------------------------------


def plain_middle(doc_id, text, percent=50, first=80):
    t = UNIT.findall(text)
    h = [int(x, 16) for x in re.findall("." * 8, sha("42:", "" if doc_id is None else str(doc_id)))[:4]]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(t), "plain", None, None, text
    form = "spm" if h[3] % 100 < first else "psm"
    return len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_checkpoints_cut_where_a_plain_split_does():
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice("ab é漢😀 \n\t\x0b\x1c　") for _ in range(rng.randint(0, 60)))
        units, index = UNIT.findall(text), middle.Checkpoints(text.encode(), rng.choice([1, 2, 3, 7]))
        assert index.n == len(units)
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.cut(u) == (len(head.encode()), len(head))


def test_checkpoints_are_sparse_and_linear():
    data = ("word é " * 300_000).encode()
    index = middle.Checkpoints(data)
    assert index.n == 600_001 and len(index.units) == 600_000 // 256 + 1
    assert middle.Checkpoints(b" " * 2_000_000).n == 1 and middle.Checkpoints(b"x" * 2_000_000).n == 1


@pytest.mark.parametrize("percent", [50, 100])
def test_fill_in_middle_equals_a_plain_twin_and_restores(odd, percent):
    made = middle.fill_in_middle(odd, middle.Rule(percent=percent))
    rows = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r.doc_id, *plain_middle(r.doc_id, r.text or "", percent)) for r in odd.collect())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == want
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, r.back) for r in rows) == texts
    assert middle.fill_in_middle(odd.limit(0)).count() == 0


def test_fill_in_middle_of_a_long_text(spark):
    text = "Ein langer Text, 漢字 und mehr.\n" * 60_000
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    for r in middle.fill_in_middle(docs, middle.Rule(percent=100)).collect():
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (r.doc_id, *plain_middle(r.doc_id, text, 100))


# 12 --------------------------------------------------------------------------------------------------------------


def plain_targets(words, weights=(3, 1, 2), total=1.5, most=2.0):
    """By repeated sharing, from the sizes by source in order."""
    weight = {s: weights[k % len(weights)] for k, s in enumerate(words)}
    left, free, target = total * sum(words.values()), dict(words), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if most * free[s] < weight[s] * share]
        if not over:
            target |= {s: weight[s] * share for s in free}
            break
        for s in over:
            target[s] = most * free.pop(s)
            left -= target[s]
    return target


def test_points_before_a_time_are_counted_in_closed_form(spark):
    digits, rng = 6, random.Random(2)
    turn = lambda x: int(format(x, "06b")[::-1], 2)
    cases = [(rng.randrange(64), b) for b in range(65) for _ in range(4)]
    df = spark.createDataFrame(cases, "t long, b long")
    df = df.withColumn("turned", mixing.reversed_bits(F.col("b") % 64, digits))
    for r in df.withColumn("n", mixing.before(F.col("t"), F.col("b"), F.col("turned"), digits)).collect():
        assert r.n == sum(turn(t) < r.b for t in range(r.t)), r


def test_every_source_gets_its_slots_spread_evenly(spark):
    sources = spark.createDataFrame([("0a", 5000, 7000), ("0b", 1000, 2000), ("0c", 90, 40), ("0d", 0, 0), ("1", 3000, 3000)], "key string, words long, quota long")
    rows = mixing.schedule(sources, mixing.Mix(block=8)).orderBy("slot").collect()
    assert len({r.slot for r in rows}) == len(rows)
    for s in sources.collect():
        own = [r for r in rows if r.key == s.key]
        assert sum(r.words for r in own) == s.quota and all(0 < r.words <= 8 for r in own)
        blocks = math.ceil(s.words / 8)
        assert [r.epoch * blocks + r.block for r in own] == list(range(len(own)))  # ranks in order of time
        for cut in (len(rows) // 3, len(rows) // 2):  # by any time a source has its share, but for a few slots
            assert abs(sum(r.key == s.key for r in rows[:cut]) - len(own) * cut / len(rows)) <= 8


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_mix(docs, mix):
    rows, pieces = mixing.mixed(docs, mix)
    rows, pieces = rows.collect(), pieces.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    sizes = defaultdict(int)
    for r in sorted(docs.collect(), key=lambda r: (r.source is None, r.source or "")):
        sizes[r.source] += len(words(r.text))
    key = {s: "1" if s is None else "0" + s for s in sizes}
    target = plain_targets({key[s]: n for s, n in sizes.items()}, mix.weights, mix.total, mix.most)
    by_key, by_row, slots = Counter(), Counter(), defaultdict(list)
    for p in pieces:
        by_key[p.key] += p.taken
        by_row[p.key, p.bucket, p.at] += p.taken
        slots[p.slot].append(p)
    for r in rows:
        assert r.target == pytest.approx(target[r.key]) and by_row[r.key, r.bucket, r.at] <= mix.most * r.size
    for k, t in target.items():
        assert by_key[k] == math.floor(t + 0.5)
    for own in slots.values():
        assert len({(p.key, p.epoch) for p in own}) == 1 and sum(p.taken for p in own) <= mix.block
    for r in rows:  # no word is taken twice in an epoch
        for epoch in {p.epoch for p in pieces if (p.key, p.bucket, p.at) == (r.key, r.bucket, r.at)}:
            spans = sorted((p.first, p.first + p.taken) for p in pieces if (p.key, p.bucket, p.at, p.epoch) == (r.key, r.bucket, r.at, epoch))
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= r.size


def test_mix_meets_targets_word_by_word(spark, odd, monkeypatch):
    check_mix(odd, mixing.Mix(block=64))
    monkeypatch.setattr(mixing, "BUCKET", 2)  # several levels of buckets
    monkeypatch.setattr(mixing, "LEVEL", 2)
    monkeypatch.setattr(mixing, "CHUNK", 5)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["hot", "hot", "a", "b", None, "é", "zz"])) for i in range(120)] + [(7, "w " * 3000, "b")] * 2
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Mix(block=16))


def test_mix_of_nothing_and_of_empty_texts(spark, odd):
    rows, pieces = mixing.mixed(odd.limit(0))
    assert rows.count() == 0 and pieces.count() == 0
    rows, pieces = mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string"))
    assert {(r.doc_id, r.size, r.source_size, r.target) for r in rows.collect()} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)} and pieces.count() == 0


def test_mix_reruns_agree_whatever_the_layout(odd):
    got = [sorted(map(str, mixing.mixed(d)[1].collect())) for d in (odd, odd.repartition(7, "text"))]
    assert got[0] == got[1] and got[0]


# 13 --------------------------------------------------------------------------------------------------------------


def plain_tree(nodes):
    """(root, proof of each node as (before, after) by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(proofs)):
            p = at[k]
            other = nodes[p ^ 1] if p ^ 1 < len(nodes) else ""
            proofs[k].append((other, "") if p & 1 else ("", other))
            at[k] = p // 2
        nodes = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return (nodes[0] if nodes else None), proofs


def plain_manifest(leaves):
    """{(lang, doc_id, leaf): Counter of (subroot, root, proof)} from (lang, doc_id, leaf)."""
    groups = defaultdict(list)
    for lang, doc_id, leaf in leaves:
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([r[2] for r in sorted(groups[x], key=lambda r: r[:3])]) for x in langs}
    root, upper = plain_tree([trees[x][0] for x in langs])
    out = Counter()
    for lang, above in zip(langs, upper, strict=True):
        for row, proof in zip(sorted(groups[lang], key=lambda r: r[:3]), trees[lang][1], strict=True):
            out[lang, row[3], row[2], trees[lang][0], root, tuple([*proof, *above])] += 1
    return out


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_a_plain_tree(spark, height):
    rng = random.Random(height)
    made = [(rng.choice(["a", "b", "b", "b", None, "é", "zz"]), i, sha(str(i))) for i in range(75)] + [("one", 1, sha("x")), ("b", 3, sha("3")), ("b", 3, sha("4")), ("b", None, sha("5"))]
    leaves = spark.createDataFrame(made, "lang string, doc_id long, leaf string").withColumn("tree", F.lit("clash")).withColumn("root_", F.lit(1))
    rows = manifest.manifest(leaves, "lang", ["doc_id"], height=height).collect()
    assert Counter((r.lang, r.doc_id, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.proof)) for r in rows) == plain_manifest(made)
    assert {r.tree for r in rows} == {"clash"}
    assert manifest.manifest(leaves.limit(0), "lang", ["doc_id"]).count() == 0


def test_leaves_and_tampered_rows(spark, odd, tmp_path):
    long = spark.createDataFrame([(70_000 + i, "é" * 600_000, "en", "s", 5) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    odd.select(long.columns).union(long).write.parquet(str(tmp_path / "documents.parquet"))
    rows = manifest.op13_merkle_manifest(spark, str(tmp_path)).collect()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    docs = [(r, sha(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))) for r in odd.select(long.columns).union(long).collect()]
    want = plain_manifest([(r.lang, r.doc_id, d) for r, d in docs])
    proof = lambda p: sha(*(a + b for a, b in p))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows) == sum((Counter({(k[1], k[2], k[3], k[4], proof(k[5])): n}) for k, n in want.items()), Counter())
    changed = {(r.doc_id, d) for r, d in docs if r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert changed and {(r.doc_id, r.leaf) for r in rows if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in rows)


def test_places_in_hot_groups(spark):
    rng = random.Random(5)
    made = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(10**9)) for _ in range(3000)]
    df = spark.createDataFrame(made, "g string, v long")
    got = order.numbered(df, "g", ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.position, r.v, r.members))
    for own in by.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {len(own)}
