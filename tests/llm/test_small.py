"""Edge cases of every operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import common, exact_dedup, html_text, mixing, quality, sharding, simhash, substring_dedup, tokens, warc

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _n string, kept string, shard string, tokens string"
LONG = " ".join(f"word{i % 701} and {i % 13}" for i in range(30_000))
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls in every column, repeated rows."""
    base = prose(200, 1)
    near = base.split()
    near[40] = "changed"
    passage = prose(70, 2)
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, passage + " " + prose(30, 3)), (5, prose(30, 4) + "\n" + passage), (6, ""), (7, None), (8, " \t\n "), (9, "one"), (10, "one two"), (11, LONG), (12, prose(60, 5)), (12, prose(60, 5)), (None, base), (13, base.replace(" ", "\t ")), (14, prose(49, 6) + " last"), (15, prose(49, 6) + " last"), (16, "É ß İ <|endoftext|> 日本 \x00 \x1c x"), (17, "One TWO")]
    return [(i, t, [None, "en", "fr"][k % 3], [None, "src0", "src11", "odd"][k % 4]) for k, (i, t) in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, "x", None, "y", "z", "w") for i, t, g, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(params=[4096, 0], ids=["broadcast", "split"])
def lookup_rows(request, monkeypatch):
    """Both ways of lookups: small tables broadcast whole, and the heavy keys apart from the rest."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", request.param)


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def key(r):
    return repr(r)


def components(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# 10


def test_exact(docs, none, lookup_rows):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())].append(i)
    want = []
    for norm, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        want += [(i, least, len(ids), i == least, hashlib.sha256(norm).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, k, _ in want if k)
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_copies(none).count() == 0


# 1


def test_simhash(docs, none, lookup_rows):
    prints = [(i, simhash.majority(simhash.shingle_hashes(t or "", 3))) for i, t, *_ in corpus()]
    ids = sorted({i for i, _ in prints if i is not None})
    nodes = sorted({f for _, f in prints})
    root = components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {r: min((i for i, f in prints if i is not None and root[f] == r), default=None) for r in root.values()}
    got = simhash.simhash_components(docs, n=3).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, f"{f:016x}", least[root[f]]) for i, f in prints), key=key)
    assert simhash.simhash_components(none).count() == simhash.near_classes(none).count() == 0 and ids


def test_fingerprint_by_hand():
    import xxhash

    text = "The  cat\tSAT on É the cat"
    parts = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + 3]), 42) for i in range(len(parts) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority(simhash.shingle_hashes(text, 3)) == want
    assert simhash.majority(simhash.shingle_hashes("one two", 3)) == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_bk_tree(radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(7))) for b in base for _ in range(12)]
    tree = simhash.BkTree()
    for k, v in enumerate(values):
        tree.add(v, k)
    for v in values[::7]:
        assert sorted(i for i, _ in tree.within(v, radius)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= radius]


@pytest.mark.parametrize(("tree", "radius"), [(20_000, 2), (5, 2)])
def test_links_over_levels(spark, monkeypatch, tree, radius):
    """Shards that are cut again lose no link."""
    monkeypatch.setattr(simhash, "TREE", tree)
    r = random.Random(9)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(6)]
    fps = sorted({(b ^ sum(1 << r.randrange(62) for _ in range(r.randrange(5)))) for b in base for _ in range(25)})
    bits = {f: f & (1 << 64) - 1 for f in fps}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (bits[a] ^ bits[b]).bit_count() <= radius])
    nodes = spark.createDataFrame([(f,) for f in fps], "_fp bigint")
    links = [tuple(r) for r in simhash.near_links(nodes, radius).collect()]
    assert components(fps, links) == want and all((bits[a] ^ bits[b]).bit_count() <= radius for a, b in links)
    labels = simhash.component_labels(common.cut(spark.createDataFrame(links or [], "_a bigint, _b bigint")))
    assert {r._node: r._root for r in labels.collect()} == {n: r for n, r in want.items() if n != r or n in {x for l in links for x in l}}


def test_trees_are_bounded():
    """The open bits of the last level: 16 or fewer, for every radius that shards are made for."""
    for radius in (0, 1, 2, 3):
        *_, last = simhash.shard_levels(radius)
        assert all(64 - m.bit_count() <= simhash.FREE_BITS for _, m in last)
    assert [len(level) for level in simhash.shard_levels(2)] == [6, 36]


@pytest.mark.parametrize("rows", [4096, 0])
def test_components(spark, monkeypatch, rows):
    """Paths, stars, rings and single links, with labels in random order."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    r = random.Random(rows)
    ids = r.sample(range(10_000), 400)
    links = [(ids[0], x) for x in ids[1:120]] + list(zip(ids[120:200], ids[121:201], strict=True)) + [(ids[k], ids[210 + (k - 209) % 60]) for k in range(210, 270)] + [(ids[k], ids[k + 1]) for k in range(280, 400, 3)]
    want = components(ids, links)
    got = {x._node: x._root for x in simhash.component_labels(spark.createDataFrame(links, "_a bigint, _b bigint").repartition(5)).collect()}
    assert got == {n: want[n] for l in links for n in l}


def test_near_copies(spark):
    texts = [prose(300, s) for s in range(12)]
    rows = []
    for s, t in enumerate(texts):
        rows.append((s * 10, t, "en", "src0"))
        for k in (1, 2):  # J of 0.94 to 0.9
            w = t.split()
            w[50 * k] = "other"
            rows.append((s * 10 + k, " ".join(w), "en", "src0"))
    df = frame(spark, rows)
    found = {r.doc_id: r.component_id for r in simhash.near_classes(df).collect()}
    assert found == {i: i - i % 10 for i, *_ in rows}
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [s * 10 for s in range(12)]


def test_near_copies_are_verified(spark, monkeypatch):
    """40 pairs at each of several similarities around 0.8: linked if and only if it is 0.8 or more, in chains too."""
    rows, want = [], {}
    for pct, shared in ((70, 247), (75, 257), (78, 263), (80, 267), (82, 271), (85, 276)):  # of 300 shingles each
        assert abs(100 * shared / (600 - shared) - pct) < 0.6
        for k in range(40):
            i = 1000 * pct + 10 * k
            w = [f"{i}w{j}" for j in range(304)]
            rows += [(i, " ".join(w), "en", "src0"), (i + 1, " ".join(w[: shared + 4] + [f"{i}x{j}" for j in range(300 - shared)]), "en", "src0")]
            want |= {i: i, i + 1: i if shared / (600 - shared) >= 0.8 else i + 1}
    w = [f"c{j}" for j in range(304)]
    for k in range(4):  # neighbours at 0.8 to 0.83, others below 0.8
        rows.append((k, " ".join(w[28 * k :] + [f"d{j}" for j in range(28 * k)]), "en", "src0"))
        want[k] = 0
    rows += [(4, " ".join(w[:40]), "en", "src0"), (5, " ".join(w[:40]) + " more", "en", "src0"), (6, " ".join(w[:14]), "en", "src0"), (7, " ".join(w[:11]), "en", "src0")]
    want |= {4: 4, 5: 4, 6: 6, 7: 7}
    df = frame(spark, rows)
    assert {r.doc_id: r.component_id for r in simhash.near_classes(df).collect()} == want
    monkeypatch.setattr(simhash, "PIECE", 500)  # two sets or less a piece
    monkeypatch.setattr(simhash, "TREE", 2)  # shards that are one group as they stand
    monkeypatch.setattr(simhash, "WIDE_RADIUS", 200)  # more candidates
    assert {r.doc_id: r.component_id for r in simhash.near_classes(df.filter("doc_id < 76000")).collect()} == {i: c for i, c in want.items() if i < 76000}
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == sorted(i for i, c in want.items() if i == c)


def test_similarity_at_the_limit():
    import numpy as np

    a = np.arange(270, dtype=np.uint64)
    assert simhash.similar(a, a + np.uint64(30)) and not simhash.similar(a, a + np.uint64(31))


# 2


def removed(rows, window):
    where = defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                where[tuple(w[p : p + window])].add(i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {q for p in range(len(w) - window + 1) if i is not None and min(where[tuple(w[p : p + window])]) < i for q in range(p, p + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=key)


def test_lengths_double():
    assert substring_dedup.doubling(50) == [13, 25, 50] and substring_dedup.doubling(1) == [1]


@pytest.mark.parametrize(("window", "seed", "hot"), [(50, 16, 1000), (50, 3, 1000), (7, 2, 1000), (50, 16, 10**9), (7, 2, 10**9), (2, 1, 1000), (1, 1, 1000)])
def test_substrings(docs, monkeypatch, window, seed, hot):
    """hot 10**9: every repeated run takes the way of the hot ones."""
    monkeypatch.setattr(substring_dedup, "HOT_KEYS", hot)
    monkeypatch.setattr(substring_dedup, "SEED", seed)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1.0)
    rows = [r for r in corpus() if r[0] != 11] if window <= 2 else corpus()
    df = docs if window > 2 else docs.filter("doc_id IS NULL OR doc_id <> 11")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.remove_repeats(df, window).collect()]
    assert sorted(got, key=key) == removed(rows, window)


def test_both_halves_must_survive():
    h, words = substring_dedup.hasher(), [f"w{i}" for i in range(60)]
    numbers = h.numbers(" ".join(words))
    runs = h.runs(numbers, 25)
    assert h.candidates(numbers, runs[[3, 28, 5]], [13, 25, 50], 2).tolist() == [3]  # 5 has its first half only
    seeds = h.seeds(numbers, 13, 50)
    some = np.unique(seeds)[:1]
    inside = {p for q in np.flatnonzero(seeds == some) for p in range(q, q + 26)}
    assert set(h.candidates(numbers, some, [13, 25, 50], 1).tolist()) == inside
    assert not len(h.candidates(numbers[:10], some, [13, 25, 50], 1)) and not len(h.candidates(numbers[:10], some, [13, 25, 50], 2))


@pytest.mark.parametrize("size", [1, 2, 3, 50])
@pytest.mark.parametrize("last", [False, True])
def test_shared_runs_over_batches(size, last):
    r = random.Random(size)
    rows = sorted((r.randint(0, 9), r.randint(0, 1), r.randint(0, 6)) for _ in range(40))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size]), (pa.int64(), pa.int32(), pa.int64()))], names=["_ha", "_hb", "_id"]) for k in range(0, len(rows), size)]
    got = {(a, i) for b in substring_dedup.shared_runs(iter(batches), last) for a, i in zip(*(c.to_pylist() for c in b.columns))}
    ids = defaultdict(set)
    for a, b, i in rows:
        ids[a, b].add(i)
    assert got == {(a, i) for (a, b), v in ids.items() if len(v) > 1 for i in v if not last or i > min(v)}


def test_substrings_of_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == 0


# 3, 4


def test_token_counts(docs, none):
    import sentencepiece

    path = tokens.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t, *_ in corpus()), key=key)
    out = tokens.count_tokens(docs, path, 100, prefixes=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out), key=key) == want
    by_id = {i: t or "" for i, t, *_ in corpus()}
    for r in out:
        text = by_id[r.doc_id]
        assert len(r.prefix_tokens) == len(text) + 1 and r.prefix_tokens[-1] == r.n_tokens
        assert r.fit_chars == max(k for k, n in enumerate(r.prefix_tokens) if n <= 100)
        for k in range(0, min(len(text), 200)):
            assert r.prefix_tokens[k] == len(model.encode(text[:k]))
    assert tokens.count_tokens(none, path, 100).count() == 0


ALPHABET = [*"abcdeEIO  \n\t'sthein.,!?0123éüñßÀ", "▁", "　", "中", "日本", "😀", "İ", "ǅ", "Σ", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "é", "​", "١", "  ", "\0", "²", "'re", "'S"]


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(2000)] + [" " * k for k in range(70)] + ["a" + " " * k + "b" for k in range(40)] + ["ha" * k for k in range(40)] + ["éx", LONG]


def test_counts_as_the_library(odd_texts):
    import sentencepiece

    path = tokens.vocabulary("piece_bpe_32k.model")
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokens.piece_counter(path)
    assert [counter.total(t) for t in odd_texts] == [len(x) for x in model.encode(odd_texts)]


def test_ids_as_the_library(odd_texts):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    library, bpe = Tokenizer.from_file(path), tokens.word_bpe(path)
    for text, e in zip(odd_texts, library.encode_batch(odd_texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
        assert ids == e.ids and bpe.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    out = tokens.encode_documents(docs, path)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    back = tokens.decode_ids(out, path)
    assert sorted((r.decoded for r in back.collect())) == sorted(w[5] for w in want)
    assert tokens.encode_documents(none, path).count() == 0


def test_compatible_pairs_give_the_last_token():
    """The program over prefixes against merging the whole string, for random merges."""
    from sheafwork.llm.bpe import PrefixBpe

    r = random.Random(8)
    for _ in range(60):
        known, rank = list("abc"), {}
        for k in range(12):
            a, b = r.choice(known), r.choice(known)
            if (a, b) not in rank:
                rank[a, b] = k
                known.append(a + b)
        bpe = PrefixBpe(set(known), lambda a, b, rank=rank: rank.get((a, b)))
        for _ in range(40):
            s = "".join(r.choice("abcd") for _ in range(r.randint(1, 14)))
            assert bpe.tokens(s) == bpe.merged(s)


# 5


def poured(rooms, weights, budget):
    """Fills children in turn until each open one has its share of what is left."""
    from fractions import Fraction

    got, open_, left = {}, set(rooms), Fraction(min(budget, sum(rooms.values())))
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if rooms[k] * total <= left * weights[k]]
        if not full:
            break
        for k in full:
            got[k] = rooms[k]
        left -= sum(rooms[k] for k in full)
        open_ -= set(full)
    return got | {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}


def test_mixing(spark, none, lookup_rows):
    rows = corpus() + [(100 + k, prose(20 + k % 50, k), ["en", "de", "fr", None][k % 4], f"src{k % 7}") for k in range(300)]
    df = frame(spark, rows).repartition(4)
    total = sum(len(words(t)) for _, t, *_ in rows)
    for share, epochs in (((1, 10), 1), ((6, 10), 2), ((3, 1), 3)):
        plan = mixing.mix_plan(df, F.expr(f"_all * {share[0]} div {share[1]}"), epochs, 7, mixing.WEIGHTS).collect()
        leaf = lambda p: (p._domain, p._lang, p._source)
        tree = {leaf(p): (p.tokens * epochs, p.target) for p in plan}
        weight = lambda level, name: mixing.WEIGHTS[level].get(name, 1)
        domains = poured({d: sum(r for k, (r, _) in tree.items() if k[0] == d) for d in {k[0] for k in tree}}, {d: weight("domain", d) for d in {k[0] for k in tree}}, total * share[0] // share[1])
        for d, budget in domains.items():
            langs = {k[1] for k in tree if k[0] == d}
            shares = poured({g: sum(r for k, (r, _) in tree.items() if k[:2] == (d, g)) for g in langs}, {g: weight("lang", g) for g in langs}, budget)
            for g, b in shares.items():
                sources = {k[2]: r for k, (r, _) in tree.items() if k[:2] == (d, g)}
                for s, want in poured(sources, {s: weight("source", s) for s in sources}, b).items():
                    assert abs(tree[d, g, s][1] - want) <= 3 and tree[d, g, s][1] <= sources[s]
        assert sum(t for _, t in tree.values()) == min(total * share[0] // share[1], total * epochs)
        out = mixing.mix_sources(df, share, epochs).collect()
        used = defaultdict(int)
        for r in out:
            used[r.domain, r.leaf_lang, r.leaf_source] += len(words(r.document.text))
        longest = max(len(words(t)) for _, t, *_ in rows)
        assert all(0 <= target - used[k] <= longest for k, (_, target) in tree.items())
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(df).select("document.*").columns == df.columns


# 6


def test_archives(spark, tmp_path, lookup_rows):
    payloads = [b"", b"a" * 10, b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5, b"\n", b"\r", b"\r\n" * 7, bytes(range(256)) * 3, b"a" * 10, None, b"\xff\n" * 33, b"long line " * 4000]
    rows = [(k, None if p is None else bytearray(p), None if k % 2 else "http://x\n") for k, p in enumerate(payloads)] + [(None, bytearray(b"a" * 10), "u"), (7, bytearray(b"a" * 10), "u")]
    df = spark.createDataFrame(rows, "page_id bigint, p binary, u string").withColumn("_data", F.lit(1)).repartition(3)
    for chunk, least in ((7, 0), (1 << 20, 5)):
        path = str(tmp_path / f"w{chunk}")
        warc.write_archives(df, path, "page_id", "p", "u", least=least, chunk=chunk)
        groups = defaultdict(list)
        for i, p, _ in rows:
            groups[bytes(p or b"")].append(i)
        want = []
        for i, p, _ in rows:
            data = bytes(p or b"")
            most = max((k for k in groups[data] if k is not None), default=None)
            again = len(data) >= least and len(groups[data]) > 1 and i != most
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", most if again else None))
        got = [tuple(r) for r in warc.read_records(spark, path).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        chunks = defaultdict(dict)
        for r in warc.read_chunks(spark, path).filter("record_type = 'response' AND _id <> '7'").collect():
            assert len(r.data) <= chunk
            chunks[int(r._id)][r.chunk_no] = bytes(r.data)
        assert all(b"".join(v for _, v in sorted(c.items())) == bytes(payloads[k] or b"") for k, c in chunks.items())


def test_no_archives(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, html string, url string")
    warc.write_archives(df, str(tmp_path / "w"), "page_id", "html", "url")
    assert warc.read_records(spark, str(tmp_path / "w")).count() == 0


def archive(*records, version="1.1"):
    out = b""
    for kind, id_, block, *more in records:
        head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{id_}>", "Content-Type: application/http", *more, f"Content-Length: {len(block)}"]
        out += "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return out


def parsed_archive(data):
    parser, rows = warc.ArchiveParser(), []
    for line in data.split(b"\n")[:-1]:
        rows += parser.feed(line)
    parser.end()
    return rows


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_foreign_records(version, monkeypatch):
    """Records of other kinds are passed over wherever they stand; long payloads come in chunks, whatever bytes they hold."""
    monkeypatch.setattr(warc, "CHUNK", 10)
    payload = b"0123\n\r\n\r\n89\nabc\r\n" * 3
    head = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n"
    rows = parsed_archive(archive(("warcinfo", "i", b"software: x\r\n"), ("request", "q", b"GET /\r\n\r\n"), ("response", "urn:record:1", head + payload), ("metadata", "m", b""), ("response", "urn:record:2", head), ("revisit", "urn:record:3", head, "WARC-Refers-To: <urn:record:2>"), version=version))
    one = [r for r in rows if r[0] == "1"]
    assert b"".join(r[4] for r in one) == payload and all(len(r[4]) <= 10 for r in one) and [r[3] for r in one] == list(range(len(one)))
    assert one[-1][5:] == (True, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) and not any(r[5] for r in one[:-1])
    assert [(r[0], r[1], r[2], r[6]) for r in rows if r[0] != "1"] == [("2", "response", None, 0), ("3", "revisit", "2", None)]


def test_archive_errors():
    with pytest.raises(ValueError, match="record was expected"):
        parsed_archive(b"HTTP/1.1 200 OK\r\n")
    whole = archive(("response", "urn:record:1", b"HTTP/1.1 200 OK\r\n\r\nabc\nd"))
    for cut_at in (len(whole) - 3, len(whole) - 20, 30):
        with pytest.raises(ValueError, match="ends inside"):
            parsed_archive(whole[:cut_at] + b"\n")
    with pytest.raises(ValueError, match="digest"):
        parsed_archive(archive(("response", "urn:record:1", b"HTTP/1.1 200 OK\r\n\r\nabc", "WARC-Payload-Digest: sha1:" + "A" * 32)))


# 7


def test_counts_by_hand():
    text = "a b c a b c x\n#tag x*\n \na b c a b c x\nÉ é"
    (n, chars, symbols, lines, repeated), _ = quality.counts(text)
    w = text.split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {q for i, g in enumerate(grams) if grams.count(g) > 1 for q in (i, i + 1, i + 2)}
    assert (n, chars, symbols, lines, repeated) == (len(w), sum(map(len, w)), 2, 1, len(covered))


def test_quality(docs, none, spark, lookup_rows):
    out = quality.quality_verdicts(docs).collect()
    assert len(out) == len(corpus())
    for r in out:
        text = next(t for i, t, *_ in corpus() if i == r.doc_id)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.n_words == len(words(text))
        assert r.kept == (not r.base_failed)  # groups are too small for estimates
    assert quality.quality_verdicts(none).count() == quality.keep_good(none).count() == 0


def test_outliers_against_brute_force(spark, lookup_rows):
    import numpy as np

    rows = []
    for k in range(400):
        text = prose(80 + k % 40, k)
        if k % 10 == 3:
            text = " ".join(w + "%%%" for w in text.split())
        if k % 10 == 7:
            text = text.upper()
        rows.append((k, text, "en", "src1"))
    df = frame(spark, rows)
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(df).collect()}
    assert got == {k: k % 10 not in (3, 7) for k in range(400)}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k, v in got.items() if v]
    z = np.array([quality.counts(t)[1] for _, t, *_ in rows])
    h = int(np.ceil(len(z) * quality.COVER))

    def bins(d):
        return np.where(d < 4096, np.floor(d * 256), (1 << 20) + np.floor(np.log(np.maximum(d, 1) / 4096) * 4096))

    def step(mean, inverse):
        d = bins(np.einsum("ij,jk,ik->i", z - mean, inverse, z - mean))
        near = z[d <= np.sort(d)[h - 1]]
        cov = np.cov(near.T, bias=True) * quality.consistency() + np.diag(quality.FLOOR**2)
        return near.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def settled(mean, inverse):
        last = np.inf
        while True:
            mean, inverse, now = step(mean, inverse)
            if now >= last - 1e-9:
                return last
            last = now

    params = quality.judged(df)[2].first()
    full = np.zeros((5, 5))
    for k, (i, j) in enumerate(quality.PAIRS):
        full[i, j] = full[j, i] = params["inverse"][k] / (1 + (i != j))
    assert step(np.array(params["mean"]), full)[2] >= params["logdet"] - 1e-5  # another step finds nothing better
    assert abs(-np.linalg.slogdet(full)[1] - params["logdet"]) < 1e-9
    r = np.random.default_rng(1)
    for _ in range(30):
        some = z[r.choice(len(z), 12, replace=False)]
        other = settled(some.mean(axis=0), np.linalg.inv(np.cov(some.T, bias=True) + np.diag(quality.FLOOR**2)))
        assert params["logdet"] <= other + 1e-3


def test_small_groups_are_judged(spark, lookup_rows):
    """A source of 50 documents beside a large one, a rare language and a null one: junk goes, the rest stays."""
    rows = [(k, prose(80 + k % 40, k), "en", "src1") for k in range(300)]
    rows += [(1000 + k, prose(80 + k % 40, 500 + k), "en", "src2") for k in range(50)]
    rows += [(2000 + k, prose(80 + k % 40, 600 + k), "xx" if k % 2 else None, "src3") for k in range(20)]
    junk = {1003, 1007, 2004, 2005}
    rows = [(i, " ".join(w + "%%%" for w in t.split()) if i in junk else t, *r) for i, t, *r in rows]
    df = frame(spark, rows)
    assert {r.doc_id for r in quality.quality_verdicts(df).collect() if not r.kept} == junk
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, *_ in rows} - junk
    groups = {(r["_lang"], r["_source"]): r["n"] for r in quality.judged(df)[2].collect()}
    assert groups == {("en", "src1"): 300, ("en", quality.ALL): 350, (quality.ALL, quality.ALL): 370}


def test_chi2():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3) and quality.chi2_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


# 8


def test_sharding(docs, none):
    rows = corpus()
    out = [tuple(r) for r in sharding.shard_documents(docs, 5, vnodes=8).collect()]
    data = [(t or "").encode() for _, t, *_ in rows]
    assert sorted(((i, s, c) for i, s, c, *_ in out), key=key) == sorted(((r[0], len(d) + 8, zlib.crc32(d)) for r, d in zip(rows, data, strict=True)), key=key)
    counts = [sum(1 for r in out if r[4] == s) for s in range(5)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in range(5):
        assert sorted(r[5] for r in out if r[4] == s) == list(range(counts[s]))
    assert sharding.shard_documents(none).count() == 0


def test_keys_walk_the_ring(spark):
    """Every key's hash by another library, then clockwise from its cell past full shards, key by key."""
    import xxhash

    number = lambda x, seed: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    ids = [k * k * 7919 - 5000 for k in range(400)]
    of = {i: number(number(i, 42), number(7, 42)) for i in ids}
    nodes, room = sharding.ring(5, 8, 7), sharding.capacities(len(ids), 5, 0.0)
    order = sorted(ids, key=lambda i: (of[i] >> (64 - sharding.CELL_BITS), of[i] - (of[i] >> 63 << 64), i))
    first = {i: next((n for n, (cell, _) in enumerate(nodes) if cell >= of[i] >> (64 - sharding.CELL_BITS)), 0) for i in ids}
    want, step = {}, 0
    while len(want) < len(ids):
        for i in order:
            shard = nodes[(first[i] + step) % len(nodes)][1]
            if i not in want and room[shard]:
                room[shard] -= 1
                want[i] = shard
        step += 1
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").repartition(3)
    got = sharding.assign_shards(df, "doc_id", 5, vnodes=8).collect()
    assert {r.doc_id: r.shard for r in got} == want
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(w == s for w in want.values())))


def test_fill_against_walking():
    """Own keys first, then round by round to the next node clockwise, key by key."""
    r = random.Random(4)
    for _ in range(20):
        nodes = sharding.ring(4, 3, r.randrange(99), 5)
        counts = {c: r.randrange(9) for c in range(32)}
        room = sharding.capacities(sum(counts.values()), 4, 0.0)
        segments = sharding.fill(counts, nodes, room, 5)
        free, want = list(room), defaultdict(list)
        keys = [(c, k) for c in range(32) for k in range(counts[c])]
        first = lambda c: next((n for n, (cell, _) in enumerate(nodes) if cell >= c), 0)
        waiting, step = keys, 0
        while waiting:
            later = []
            for c, k in waiting:
                shard = nodes[(first(c) + step) % len(nodes)][1]
                if free[shard]:
                    free[shard] -= 1
                    want[c, shard].append(k)
                else:
                    later.append((c, k))
            waiting, step = later, step + 1
        got = defaultdict(list)
        for c, a, b, s in segments:
            got[c, s] += range(a, b)
        assert got == want


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_movement_is_limited(slack):
    """One more shard: most keys stay where they were (one in 25 must move)."""
    r = random.Random(6)
    counts = {c: r.randrange(5, 15) for c in range(1 << 13)}

    def places(n):
        out = {}
        for c, a, b, s in sharding.fill(counts, sharding.ring(n, 64, 7), sharding.capacities(sum(counts.values()), n, slack)):
            out |= {(c, k): s for k in range(a, b)}
        return out

    one, two = places(24), places(25)
    assert sum(one[k] != two[k] for k in one) < 0.12 * len(one)


# 9


def test_rendering():
    page = '<title>t</title><h1>Hi  there</h1><p>one<b>two</b> three<br>four<p>five &amp; six<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>after<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>日本<td>10</table><pre>x\n  y</pre><div style="display:none">no</div><p hidden>no</p>3 < 4 and <!-- c --> ok</div></b><script>if (a<b) "</p>"</script>'
    assert html_text.render(page).split("\n") == ["Hi there", "", "onetwo three", "four", "", "five & six", "", "- a", "- b", " 3. c", " 4. d", "- e", "", "after", "", "Name       Qty", "apple pie  3", "日本       10", "", "x", "  y", "", "3 < 4 and ok"]


@pytest.mark.parametrize(("page", "text"), [("", ""), (" \n ", ""), ("plain", "plain"), ("<", "<"), ("a<b", "a"), ("<p", ""), ("</p>x", "x"), ("<table><td>a<table><td>b</table><td>c", "a  c\n\nb"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<blockquote>q</blockquote>z", "  q\n\nz"), ("<!-- open", ""), ("<textarea><p>x</textarea>y", "<p>xy"), ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>k", "yes\nk"), ("<details><summary>S</summary>no<p>no</details>z<details open><summary>T</summary>u</details>", "S\nz\nT\nu"), ("<div hidden><details><summary>S</summary>x</details></div>y", "y"), ("<svg><title>t</title><text>a</text></svg><math><mi>x</mi></math><select><option>b<option>c</select>", "ax\nb\nc"), ("x<script>no", "x"), ("<a title='>'>k</a>", "k")])
def test_odd_pages(page, text):
    got = html_text.render(page)
    assert got == text


def test_tables_against_a_dense_grid():
    """Random cells with colspan and rowspan, placed cell by cell in a grid, against the renderer's lines."""
    r = random.Random(12)
    for _ in range(200):
        grid, source, placed = defaultdict(bool), "<table>", []
        rows = r.randint(1, 4)
        for y in range(rows):
            source, x = source + "<tr>", 0
            for _ in range(r.randint(1, 4)):
                while grid[y, x]:
                    x += 1
                wide, high, text = r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2]), "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
                source += f"<td colspan={wide} rowspan={high}>{text}"
                placed.append((y, x, wide, text))
                for a in range(high):
                    for b in range(wide):
                        grid[y + a, x + b] = True
                x += wide
        width = defaultdict(int)
        for _, x, wide, text in placed:
            if wide == 1:
                width[x] = max(width[x], len(text))
        want = []
        for y in range(rows):
            line = ""
            for _, x, _, text in sorted(c for c in placed if c[0] == y):
                at = sum(width[k] + 2 for k in range(x))
                line = (line + "  " if line else "").ljust(at) + text
            want.append(line)
        assert html_text.render(source + "</table>").split("\n") == want


def test_cost_is_in_proportion():
    import time

    began = time.process_time()
    html_text.render("<p><button>" + "<i>" * 8000 + "<div>" * 8000)
    page = "<table><tr><td>" + "w" * 30_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(html_text.render(page)) < 3 * len(page)
    page = "<table><tr>" + "<td>" * 4000 + "x<br>" * 4000
    assert len(html_text.render(page)) < 3 * len(page)
    assert time.process_time() - began < 5


def test_deep_and_hostile_pages():
    for page in ("<div>" * 50_000, "<p>" * 50_000, "<table>" * 2000, "<" * 50_000, '<a "' * 10_000, "<ul><li>" * 3000, "</div>" * 50_000, "<!" * 50_000):
        html_text.render(page)


def test_extract_text(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None), (2, "x" * 300_000)], "page_id bigint, html string").withColumns({c: F.lit("clash") for c in ("text", "_id", "_html", "n_chars")})
    out = sorted(((r.page_id, r.text) for r in html_text.extract_text(df).collect()), key=key)
    assert out == sorted([(1, "a"), (1, "a"), (None, ""), (2, "x" * 300_000)], key=key)
    assert html_text.extract_text(df.limit(0)).count() == 0
