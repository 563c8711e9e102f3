"""Ops 11 to 13 against brute-force versions, on texts with every awkward case."""

import collections
import functools
import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import align, audit, bytepair
from memloom.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n long, a int, term string, groups string, segment string, ids binary"
PARTS = [" ", "  ", "\n", "\t", "\r", ");", "a", "é", "'", "'s", "'re", "s", "ve", "ll", "the", "ing", "1", "½", "!", "漢", "😀", "́", " ", " ", "▁", "​", "\x1c", "\x85", "\0", "<|endoftext|>", "<s>", "<0x0A>", "ß", "İ", "\U00010d4a"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    out = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(["Alpha", "beta", "ÉTÉ", "x", "12", "don't", "end."]) for _ in range(n))
    out += [say(rnd.randint(1, 40)) for _ in range(150)]
    return [None, "", " ", "   ", "\n\n", "▁", say(40_000), "x" * 20_000, "ab" * 5_000, "'" * 999, " " * 3_000, *out, *out[:60]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 20 else i // 2 if i in (30, 31) else i, t, [None, "en", "en", "en", "de"][i % 5], [None, "hot", "s", "hot"][i % 4], 5, 6, "clash", "g", "s", b"i") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return collections.Counter(rows)


# op 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bytepair.known_vocabulary(vocabulary("byte_bpe_multi_50k.tiktoken")).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trips(docs, none, texts, library):
    got = key((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytepair.round_trips(docs).collect())
    want = []
    for t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == key(want)
    assert bytepair.round_trips(none).count() == 0
    assert [r.doc_id for r in bytepair.round_trips(docs.where("doc_id IS NULL")).collect()] == [None]


def test_ids_are_the_librarys(library):
    words, rnd = bytepair.known_vocabulary(vocabulary("byte_bpe_multi_50k.tiktoken")), random.Random(11)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 16))) for _ in range(8000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(30_000))]
    ids, count = words.encode(texts)
    ends = np.cumsum(count)
    for t, a, b in zip(texts, ends - count, ends):
        assert ids[a:b].tolist() == library.encode_ordinary(t), t


def test_scan_equals_a_walk():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 7, 64, 1000, 5000):
        for width in (1, 3, 64, 1024):
            symbol = rnd.integers(0, 9, n).astype(np.uint8)
            state, want = bytepair.CLOSED, []
            for c in symbol:
                want.append(state)
                state = bytepair.NEXT[state, c]
            assert bytepair.states_before(symbol, width).tolist() == want


def test_long_pieces_merge_alike():
    words, rnd = bytepair.known_vocabulary(vocabulary("byte_bpe_multi_50k.tiktoken")), random.Random(2)
    for n in range(2, 200, 7):
        piece = bytes(rnd.choice(b"aabeinst' \xc3\xa9") for _ in range(n))
        assert words.merged(piece) == words.merged_by_heap(piece)


def test_offsets_and_foreign_ids(docs, spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = bytepair.encode(docs.select("doc_id", "text"), path)
    for r in rows.limit(50).collect():
        ends = struct.unpack(f"<{r.n_tokens}I", r.ends)
        assert list(ends) == sorted(ends) and len(r.ids) == 4 * r.n_tokens
    wrong = rows.where("n_tokens > 3").limit(1).withColumn("ends", F.expr("overlay(ends PLACING X'FF' FROM 1 FOR 1)"))
    with pytest.raises(Exception, match="disagree"):
        bytepair.decode(wrong, path).collect()
    assert bytepair.decode(spark.createDataFrame([(1, 0, None, None)], rows.schema), path).first().decoded is None


# op 12


@functools.cache
def token_bytes(both):
    return [[bytes(x.flat[s : s + n]) for s, n in zip(x.start, x.size)] for x in (both.a_bytes, both.b_bytes)]


def aligned(both, text):
    """(groups, [(A id, B id)]) from whole texts."""
    if not text or "▁" in text:
        return None, []
    raw = " " + text
    a, b = both.a.encode(raw, add_special_tokens=False).ids, both.b.encode(text)
    table_a, table_b = token_bytes(both)
    assert b"".join(table_a[i] for i in a) == b"".join(table_b[i] for i in b) == raw.encode()
    groups, links, x, y, at_a, at_b = [], [], [], [], 0, 0
    j = 0
    for i in a:
        x.append(i)
        at_a += len(table_a[i])
        while at_b < at_a:
            y.append(b[j])
            at_b += len(table_b[b[j]])
            j += 1
        if at_a == at_b:
            groups.append((x, y))
            links.append((i, y[-1]))
            x, y = [], []
    return groups, links


def test_alignment(docs, none, texts):
    both = align.pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    found = [aligned(both, t) for t in texts]
    count = collections.Counter(x for _, links in found for x in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for groups, links in found:
        if groups is None:
            want.append((0,) * 6 + ("",))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sizes = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups)
        want.append((*sizes, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    out = align.alignments(docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = out.collect()
    assert key(tuple(r)[1:] for r in rows) == key(want)
    assert sum(r.doc_id is None for r in rows) == 1
    assert align.alignments(none).count() == 0
    assert [tuple(r)[1:] for r in align.alignments(docs.where("text IS NULL")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_segments_align_as_whole_texts_do():
    both = align.pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    rnd = random.Random(3)
    texts = [t for t in ("".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 16))) for _ in range(4000)) if t and "▁" not in t]
    raw, start, count = both.segments(texts)
    bounds = [*start.tolist(), len(raw)]
    groups = both.align([raw[a:b].decode() for a, b in zip(bounds, bounds[1:])]).column("groups").to_pylist()
    at = 0
    for t, n in zip(texts, count.tolist()):
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in aligned(both, t)[0])
        assert ";".join(groups[at : at + n]) == want, t
        at += n
    # a piece of the second vocabulary holds these two side by side
    assert [both.segments(["x;\ry"])[2][0], both.segments(["x y"])[2][0]] == [1, 2]


def test_blocks_hold_every_document(docs, texts):
    both = align.pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    block = align.Block()
    for i in range(0, len(texts), 50):
        some = [t or "" for t in texts[i : i + 50]]
        block.add(both, list(range(i, i + len(some))), some)
    *listed, last = [r for b in block.rows(5) for r in b.to_pylist()]
    assert [r["code"] for r in listed] == list(range(len(listed))) and {r["block"] for r in listed} == {5}
    counts = align._unsqueezed(last["counts"], last["n_docs"], "<i8").tolist()
    codes = align._unsqueezed(last["codes"], last["n_codes"], "<u4").tolist()
    assert [r["n"] for r in listed] == [n for _, n in sorted(collections.Counter(codes).items())]
    at = 0
    for t, n in zip(texts, counts):
        assert "".join(listed[c]["segment"] for c in codes[at : at + n]) == (" " + t if t and "▁" not in t else "")
        at += n


# op 11


def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    n, df, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", term.findall(low(text or ""))
        groups.add((lang, source))
        df.update((lang, t) for t in set(found))
        n.update((lang, source, t) for t in found)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), k in df.items() if x == lang and k >= least]
        sources = sorted(s for x, s in groups if x == lang)
        size = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        total = {t: sum(n[lang, s, t] for s in sources) for t in kept}
        share = lambda c, m: 1 + 1_000_000_000 * (c + 2) // (m + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(n[lang, s, t], size[s]) for s in sources for t in kept}
        q = {t: share(total[t], sum(size.values())) for t in kept}
        for s in sources:
            pairs = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s, t], q[t]), t) for t in kept if n[lang, s, t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(items[:most], 1)]
    return key(out)


@pytest.mark.parametrize("least,top", [(10, 10), (2, 3), (10_000, 10)])
def test_source_audit(docs, texts, least, top):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert key(tuple(r) for r in audit.source_audit(docs, least, top).collect()) == audited(rows, least, top)


def test_source_audit_of_many_sources_and_small_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 12))), rnd.choice(["x", "y"]), f"s{rnd.randint(0, 40) if i % 3 else 0}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, value in (("BLOCK", 300), ("ROWS", 7), ("PAIRS", 50)):
        monkeypatch.setattr(audit, name, value)
    got = audit.source_audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert key(tuple(r) for r in got.collect()) == audited([(r[2], r[3], r[1]) for r in rows], 10, 10)


def test_source_audit_without_rows(none, spark):
    assert audit.source_divergence(none).count() == 0
    lone = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert audit.source_divergence(lone).count() == 0


def test_counts_beyond_64_bits_stay_exact(spark):
    """1e9 times a count of 1e12 needs more than 64 bits."""
    n, size, terms = 10**12, 7 * 10**12 + 3, 10**6
    row = spark.createDataFrame([(n, size, terms)], "n long, size long, terms long").select(audit.probability("n", "size", "terms")).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 2) // (size + 2 * terms)
