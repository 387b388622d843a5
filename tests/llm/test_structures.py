"""The manifest, conversation repair and near-duplicate vectors against brute force."""

import hashlib
import itertools
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, components, conversations, jaccard, manifest, neardup, shingles
from sievework.llm.common import stored
from sievework.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars int, hash string, pos int, slots string, g string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, fanout):
    paths, current, where = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(current) > 1:
        for k, at in enumerate(where):
            first = at // fanout * fanout
            run = current[first : first + fanout]
            paths[k].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            where[k] = at // fanout
        current = [digest(*current[i : i + fanout]) for i in range(0, len(current), fanout)]
    return current[0], paths


def brute_manifest(rows, fanout=2):
    """rows of (doc_id, text, lang, source, n_chars)"""
    groups = {}
    for i, text, lang, source, n in rows:
        own = digest(*map(part, (i, source, lang, n, text)))
        found = digest(*map(part, (i, source, lang, None if n is None else n + 1, text))) if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else own
        groups.setdefault(lang, []).append(((i is not None, i or 0, own), own, found, i))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in langs:
        groups[lang].sort(key=lambda x: x[0])
        made.append(tree([x[1] for x in groups[lang]], fanout))
    root, upper = tree([top for top, _ in made], fanout)
    out = []
    for lang, (top, paths), above in zip(langs, made, upper):
        for (_, own, found, i), path in zip(groups[lang], paths):
            value = found
            for before, after in path + above:
                value = digest(before, value, after)
            out.append((i, own, top, root, digest(*[b + a for b, a in path + above]), value, value == root))
    return sorted(out, key=repr)


def made_manifest(df, fanout=2):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = manifest.manifest(df, tampered={"n_chars": F.col("n_chars").cast("long") + 1}, when=changed, fanout=fanout)
    return sorted((tuple(r) for r in got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def many(n):
    rng = random.Random(4)
    rows = [(rng.randrange(n), f"text {i} é😀", rng.choice(["en"] * 6 + ["de", "fr", None, "é", "z"]), rng.choice(["a", None]), rng.choice([None, i])) for i in range(n)]
    return rows + [(None, None, None, None, None)] * 3 + [(7, "copy", "en", "a", 4)] * 5 + [(9, "", "en", "a", 0), (9, "x" * 2_000_000, "en", "a", 1), (11, "alone", "xx", "a", 5)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest(spark, fanout):
    rows = many(400)
    df = spark.createDataFrame([(*r, "h", 1, "s", "g") for r in rows], DOCS)
    assert made_manifest(df, fanout) == brute_manifest(rows, fanout)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(5, "only", "en", "a", 4, "h", 1, "s", "g")], DOCS)
    got = made_manifest(df)
    assert got == brute_manifest([(5, "only", "en", "a", 4)])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest()
    assert made_manifest(df.filter("doc_id < 0")) == []


def test_manifest_finds_a_changed_row(spark):
    rows = [(i, f"t{i}", "en", "a", i) for i in range(40)]
    df = spark.createDataFrame([(*r, "h", 1, "s", "g") for r in rows], DOCS)
    got = manifest.manifest(df, tampered={"text": F.lit("other")}, when=F.col("doc_id") == 17).collect()
    assert [r["id"] for r in got if not r["verified"]] == [17]


# Conversations


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(conversations.SPACE)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute_repair(rows):
    """All edit sequences of up to two insertions at a place, cheapest first, then by audit."""
    marks, best = faults(rows), None

    def ends(roles):
        rest = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2) and len(rest) % 2 == 0)

    def options(row, mark):
        (role, text), more = row, 5 if mark == 3 else 0
        out = [(2, "D", [])]
        if mark in (0, 3):
            out += [(more, "K", [(role, text)])] + [(1 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        return out

    fill = [(0, "", [])] + [(5 * k, "I" * k, [(r, "") for r in rs]) for k in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=k)]
    places = [fill]
    for row, mark in zip(rows, marks):
        places += [options(row, mark), fill]
    for chosen in itertools.product(*places):
        cost = sum(c for c, _, _ in chosen)
        if best is not None and cost > best[0]:
            continue
        out = [x for _, _, part in chosen for x in part]
        if ends("".join(r[:1] if r else "-" for r, _ in out)):
            found = (cost, "".join(a for _, a, _ in chosen), "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best, found) if best else found
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def repaired(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, fault int")
    return {r["conv_id"]: r for r in conversations.repair(df, **options).collect()}


def test_repair_equals_all_edit_sequences(spark):
    rng, rows, want = random.Random(2), [], {}
    for conv in range(60):
        talk = [(rng.choice(["user", "user", "assistant", "system", "tool", "", "ux"]), rng.choice(["Yes.", "No!", "cut", "", " \n", "Why? \t", "é."])) for _ in range(rng.randrange(1, 4))]
        rows += [(conv, turn, role, text) for turn, (role, text) in enumerate(talk)]
        want[conv] = brute_repair(talk)
    got = repaired(spark, rows)
    assert {k: (r["cost"], r["audit"], r["repaired_sha256"]) for k, r in got.items()} == want


def test_repair_counts(spark):
    rows = [
        (1, None, "user", "First."), (1, 2, "assistant", "Second."), (1, 6, "user", "open"), (1, 6, "user", "open"), (1, 7, None, None),
        (None, 1, "user", "Hi."), (None, 1, "assistant", "Hi."), (3, None, "user", ""), (4, 5, "system", "Be kind."),
    ]
    got = repaired(spark, rows)
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"]) == (7 - 2 + 1 - 3, 1, 1, 1)
    assert one["illegal"] == 2 and one["audit"] == "KKDDD" and one["cost"] == 6
    assert got[None]["audit"] == brute_repair([("assistant", "Hi."), ("user", "Hi.")])[1]
    assert (got[3]["gaps"], got[3]["audit"], got[3]["repaired_sha256"]) == (0, "D", digest())
    assert (got[4]["cost"], got[4]["audit"]) == (2, "D")


def test_repair_streams_long_conversations(spark):
    """One conversation over many batches, with texts of some megabytes, against the same edits worked out one by one."""
    rows = [(1, t, "user", f"Line {t}.") for t in range(25_000)] + [(2, 0, "user", "a" * 5_000_000 + "."), (2, 1, "assistant", "b" * 5_000_000)]
    got = repaired(spark, rows)
    assert len(got[1]["audit"]) == 25_000 and got[1]["cost"] == 12_500 and set(got[1]["audit"]) == {"K", "R"}
    assert got[1]["audit"] == "KR" * 12_500
    text = "\n".join(f"{('user', 'assistant')[t % 2]}:Line {t}." for t in range(25_000))
    assert got[1]["repaired_sha256"] == digest(text)
    assert (got[2]["cost"], got[2]["audit"]) == (4, "DD")


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(30) for t in range(20) for r, x in [("assistant", f"A.{c}! {t}?")]] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, code int")
    got = {}
    for r in conversations.damage(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["lost"]))
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        want = [("user" if code == 4 else role, text, code == 0)] * (2 if code == 3 else 1)
        assert got[conv, turn] == want
    lost = conversations.repair(conversations.damage(df).withColumn("lost", F.lit(True)), F.col("lost")).collect()
    assert len(lost) == 31 and all(r["audit"] == "" and r["cost"] == r["gaps"] == 0 and r["repaired_sha256"] == digest() for r in lost)
    assert conversations.repair(df.filter("conv_id < 0")).collect() == []


# Vectors


def brute_links(rows, threshold=0.9):
    """rows of (vec_id, vector or None): a list of (vec_id, links, component)"""
    fine = [x is not None and len(x) > 0 and all(y is not None and np.isfinite(y) for y in x) and any(x) for _, x in rows]
    width = max([len(x) for _, x in rows if x] or [1])
    unit = [np.pad(np.array(x, float), (0, width - len(x))) / np.max(np.abs(x)) if ok else None for ok, (_, x) in zip(fine, rows)]
    unit = [u / np.sqrt((u * u).sum()) if u is not None else None for u in unit]
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if fine[i] and fine[j] and (unit[i] * unit[j]).sum() >= threshold:
            links[i] += 1
            links[j] += 1
            label[max(root(i), root(j))] = min(root(i), root(j))
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[root(i)] = min(key, names.get(root(i), key))
    return sorted(((key, links[i], names.get(root(i))) for i, (key, _) in enumerate(rows)), key=repr)


def found_links(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, node int, u int, links int")
    result = neardup.near_duplicates(df, **options)
    got = result.rows.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return result, sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    far = rng.normal(size=(600, 24)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(far)]
    rows += [(1000 + i, (far[i] + 0.2 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(80)]  # a near copy each
    tight = [(2000 + i, (far[90] + 0.02 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(90)]  # a crowd that lists can't hold
    wide = [(3000 + i, (far[91] + 0.3 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(90)]  # some of it not linked with each other
    rows += tight + wide + [(4000, far[92].tolist()), (4001, (far[92] * 3).tolist()), (4001, far[93].tolist()), (92, far[94].tolist())]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] * 24), (5005, [1.0, 2.0]), (None, far[95].tolist()), (None, (far[599] * -1).tolist())]
    result, got = found_links(spark, rows)
    want = brute_links(rows)
    assert result.recall >= neardup.RECALL
    assert got == want


def test_near_vectors_of_few_rows(spark):
    assert found_links(spark, [(1, [1.0, 0.0])])[1] == [(1, 0, 1)]
    assert found_links(spark, [(2, [1.0, 0.0]), (1, [2.0, 0.0])])[1] == [(1, 1, 1), (2, 1, 1)]
    assert found_links(spark, [(1, None)])[1] == [(1, 0, 1)]
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neardup.near_duplicates(df).rows.collect() == []


def test_large_components_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 40)
    monkeypatch.setattr(neardup, "LOOSE", 16)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    rows = [(i, (centre + s * rng.normal(size=24)).astype(np.float32).tolist()) for i, s in enumerate([0.1] * 100 + [0.3] * 60)]
    assert found_links(spark, rows)[1] == brute_links(rows)


def test_many_sets_are_signed_as_each_by_itself():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in [0, 1, 5, 9, 10, 11, 12, 16, 17, 21, 22, 33, 43, 44, 300, 351, 352, 1500] for _ in range(3)]
    signs, places, needed = jaccard.all_signatures(sets)
    for i, s in enumerate(sets):
        mine = places == i
        sign, need = jaccard.signatures(s)
        assert sorted(zip(signs[mine].tolist(), needed[mine].tolist())) == sorted(zip(sign.tolist(), need.tolist())), len(s)
    assert jaccard.all_weak(sets).tolist() == [jaccard.weak(s) for s in sets]


def test_words_are_hashed_in_bounded_memory():
    """Of a batch of 4 MB no more than a few arrays of eight bytes for each byte are held, and pieces are smaller still."""
    text = "word of text " * (1 << 14)
    tracemalloc.start()
    shingles.sets(pa.array([text] * 8))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 * 8 * len(text)
    assert jaccard.TEXTS <= 1 << 18


def test_small_groups_are_compared_once(spark):
    """Members of different components that may be linked, of groups of at most 64, in one pass; larger ones in pairs of chunks."""
    sketch = lambda i: jaccard.classes(np.arange(100 * i, 100 * i + 100, dtype=np.uint64) << np.uint64(8))
    texts = spark.createDataFrame([(i, 100 if i else 50, sketch(0)) for i in range(6)] + [(i, 100, sketch(0)) for i in range(10, 100)], "node long, n long, classes binary")
    labels = spark.createDataFrame([(2, 1), (1, 1)], "node long, component long")
    groups = spark.createDataFrame([(7, i, 6) for i in range(6)] + [(8, i, 90) for i in range(10, 100)], "name long, node long, members long")
    small = {(r.a, r.b) for r in jaccard._across_small(groups, labels, texts).collect()}
    assert small == {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} - {(1, 2)}
    large = {(r.a, r.b) for r in jaccard._across(groups, labels, texts).collect()}
    assert large == {(a, b) for a in range(10, 100) for b in range(a + 1, 100)}


def test_stored_words_stay_bounded(monkeypatch):
    """A worker lives on for later stages: it keeps two halves of the store and one piece, whatever it has read, and says the same."""
    texts = [" ".join(f"word{i} {i * 7919} the {chr(97 + i % 26) * 3}" for i in range(k * 100, k * 100 + 100)) for k in range(40)]
    whole = bpe.Encoder(bpe.Vocabulary(vocabulary_path())).encode(texts)
    monkeypatch.setattr(bpe, "STORE", 300)
    encoder, got = bpe.Encoder(bpe.Vocabulary(vocabulary_path())), []
    learned = []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learned.extend(words), learn(words)))
    for text in texts:
        got += encoder.encode([text])
        assert len(encoder.store) + len(encoder.older) <= 2 * (300 + 800)
    assert got == whole
    assert learned.count(" the") == 1


def test_large_groups_are_read_against_pivots(spark, monkeypatch):
    """Near copies of one text and texts with one passage: the components of a brute force, without comparing whole groups in chunks."""
    rng = random.Random(5)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(40)]
    copies = [[f"e{rng.random()}" if i in edits else w for i, w in enumerate(base)] for edits in (set(rng.sample(range(150), rng.choice([0, 1, 2, 3, 7, 8, 9]))) for _ in range(60))]
    copies += [["z"] + c[1:] for c in copies[-12:]]  # each linked to the one before it, far from the text
    mixed = [[f"w{rng.random()}" for _ in range(120)] + passage for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(copies + mixed)]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    expected = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            low, high = sorted((expected[i], expected[j]))
            expected = [low if c == high else c for c in expected]
    monkeypatch.setattr(jaccard, "SMALL", 8)
    compared, across = [], jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda groups, *more: compared.append(groups.count()) or across(groups, *more))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(expected))
    assert sum(compared) <= 3 * len(rows)


def test_packed_signatures_take_few_bytes_in_any_number_of_buckets(spark):
    """Seven bytes for each signature and a first node for each row, however few signatures of a batch a bucket has."""
    rng = random.Random(7)
    rows = [(5_000_000_000 + 3 * i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for i in range(300)]
    texts = spark.createDataFrame(rows, "node long, text string").coalesce(1)
    held = {}
    for buckets in (3, 3000):
        packed = jaccard._packed(texts, buckets).collect()
        count = sum(len(r["signs"]) // 4 for r in packed)
        assert sum(len(x) for r in packed for x in r[1:]) <= 7 * count + 8 * len(packed)
        held[buckets] = count
    assert held[3] == held[3000] > 20_000


def test_nodes_that_lie_apart_are_packed(spark):
    """Nodes in any order and at any distance come out of the groups of equal signatures."""
    nodes = [5, 1 << 40, 3 << 33, 70_000, 1, (1 << 33) + 2]
    texts = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(60))) for n in nodes], "node long, text string").coalesce(1)
    for buckets in (1, 50):
        pairs = jaccard._pairs_of(jaccard._stars(jaccard._packed(texts, buckets)), 2).collect()
        assert {tuple(r) for r in pairs} == {(1, n) for n in nodes if n != 1}


def test_sizes_of_linked_sets_lie_in_neighbouring_steps():
    n = np.arange(1, 20_000)
    largest = 4 * n // 3
    assert (jaccard.steps_of(largest).astype(int) - jaccard.steps_of(n) <= 1).all()
    assert jaccard.steps_of(np.array([2**31 - 1]))[0] < 100


def test_members_send_no_more_outside_shingles_than_needed(spark):
    """Near copies beside a pivot: the tables hold no shingle lists, and what a set has to share anyway isn't sent."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, i, 0, 80, " ".join([f"w{rng.random()}" for _ in range(100)] + passage)) for i in range(80)]
    held = spark.createDataFrame(rows, "cluster long, node long, component long, members long, text string")
    pivot = np.sort(shingles.sets(pa.array([" ".join(passage)]))[0])
    pivots = spark.createDataFrame([(1, 80, bytearray(pivot.tobytes()), bytearray())], "cluster long, members long, pivot binary, common binary")
    members = jaccard._against_pivots(held, pivots)
    facts = jaccard._facts(members)
    judged = jaccard._judged(members, facts).collect()
    assert not any(kind == "binary" for _, kind in members.dtypes)
    packed = jaccard._outside_packed(held, pivots, facts, 5).collect()
    assert sum(len(r["signs"]) // 4 for r in packed) == sum(max(r.n - r.t - max(r.shares, 1) + 1, 0) for r in judged) <= 80 * (0.25 * 156 + 2)
    for r in judged:
        assert r.shares == jaccard.shared_outside(np.array([r.n]), np.array([r.t]), np.array([r.least]))[0]


def test_shuffle_files_go_with_the_write(spark):
    """What a stored table was shuffled for is not left on the executors' disks until the driver collects its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    of = lambda: {b.name() for b in (blocks.apply(i) for blocks in [disk.getAllBlocks()] for i in range(blocks.size())) if b.isShuffle()}
    before, setting = of(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counted = stored(spark.range(5000, numPartitions=4).groupBy((F.col("id") % 700).alias("k")).count(), "counted")
    for _ in range(50):
        if not of() - before:
            break
        time.sleep(0.2)
    assert not of() - before
    assert counted.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


@pytest.mark.parametrize("few", [1 << 20, 3])
def test_components_of_few_and_of_many_links(spark, monkeypatch, few):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (5000, 5000)]
    rest = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in rest:
        for a, b in links:
            if a != b:
                rest[a] = rest[b] = min(rest[a], rest[b])
    monkeypatch.setattr(components, "FEW", few)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == sorted(rest.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
