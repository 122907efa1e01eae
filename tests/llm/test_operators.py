"""Corpus operators against brute force, on a table of awkward rows: nulls, empty and very long texts, ties, repeated
rows, clashing extra columns; and on an empty table."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import cuckoo, dropout, langid, media, packing, pii, simhash, suffix, tokenfiles, tokens, warc
from strataflow.llm.common import shared_dir, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp int, `group` int"


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinorstlé", k=rng.randint(1, 9))) for _ in range(300)]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 220))) for _ in range(40)]
    shared = " ".join(rng.choices(words, k=60))
    made = prose + [shared + " " + p for p in prose[:6]] + [prose[0]] * 4 + [prose[1].replace(" ", "  ", 1), prose[1] + " ."]
    made += [None, "", " ", "  \n", "x", "!!", "Orre " * 3000, "q" * 20_000, "a\x1c b　c ▁ d", "İΣ <|endoftext|> 中文 🙂", "mail a.b@c.de_f@g.hi, 10.0.0.255 999.1.1.1 1.2.3.4.5"]
    made += ["card 4111 1111-1111 1111 tel +49 (0) 30-1234567 iban DE89 3704 0044 0532 0130 00 x", "4111111111111112 +12", "1" * 5000 + "@" * 50, "1.2.3." * 800, "a@b." * 900]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    made = texts()
    rows = [(i, t, ["en", None, "de"][i % 3], "s", None, "d", 1, 2) for i, t in enumerate(made)]
    rows += [(None, made[2], "en", None, 3, None, None, None)] * 2 + [rows[3]] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


def same(found, want):
    assert sorted(map(key, found)) == sorted(map(key, want))


def library(name):
    """The tokenizers library's own object, as the contract calls it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_packing(docs, empty):
    out = packing.harmonic_pack(docs).collect()
    plain = library(packing.VOCABULARY)
    left = collections.Counter()  # each document's ids from each of its pieces' starts on, as checksums of all their beginnings
    for i, t in pairs(docs):
        left[i, (*plain.encode(t, add_special_tokens=False).ids, 0)] += 1
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for (i, ids), n in left.items():
        want[i, len(ids)] += [np.array(ids, "<u4")] * n
    assert want.keys() == pieces.keys()
    for k, found in pieces.items():  # rows that share id and length: every start is covered once for each of them
        cover = collections.Counter(x for a, n, _ in found for x in range(a, a + n))
        assert cover == dict.fromkeys(range(k[1]), len(want[k]))
        assert all(any(zlib.crc32(ids[a : a + n].tobytes()) == crc for ids in want[k]) for a, n, crc in found)
    total = sum(k[1] * len(v) for k, v in want.items())
    full, padding = collections.defaultdict(list), 0
    for r in out:
        full[r.sequence_id].append(r)
    for rows in full.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * total
    assert packing.harmonic_pack(empty).collect() == []
    assert all(sum(packing.cuts(n)) == n for n in range(1500))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e, plain = tokens.Encoder(name, most=40_000), library(name)
    rng = random.Random(1)
    odd = ["  ", "\n", " \n  ", "\t", "\x1c", "　", "\xa0", "'s", "<|endoftext|>", "\x85", "é", "é", "中", "🙂", "İ", "Σ", "ﬁ"]
    for t in [x or "" for x in texts()]:
        for _ in range(3):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(odd) + t[at:]
        assert e.ids([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    for t in ("end <|endoftext|> next", "<|startoftext|>", "a<|ENDOFTEXT|>b", "<|endoftext|", " <|endoftext|>  <|startoftext|> x", "<|endoftext|><|endoftext|>"):
        assert e.ids([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_with_marks_need_no_pattern(name, monkeypatch):
    """A known word before a mark or a line break is looked up: neither the pattern nor the merge model is asked again."""
    e, plain = tokens.Encoder(name), library(name)
    e.ids(["a a word Word señor Señor a\nword a\nseñor", "word, word"])
    for mark in (".", ",", ".,", "!)", "'.", '"', "'"):
        e.ids([mark])
    merged = []
    merge = e._merge
    monkeypatch.setattr(e, "_merge", lambda letters: merged.append(letters) or merge(letters))
    monkeypatch.setattr(e, "_mixed", lambda part: pytest.fail(part))
    for t in ("word, Word. señor., a!) word'. Señor\" word'", "a word.\nword, señor.\nword"):
        assert e.ids([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert not merged
    monkeypatch.undo()
    for t in ("dog's dogs' 's. a'll, it's.\nIt's", "x\n\ny. \n z\n", "x\n y", "².\nª, µ! ·. ½a b½, ÿ", "İ. ﬁ,\nﬁ a.\x0b b\x1c,", "naïve…, “word”.", ".\n.", "\nword.", "word.\n"):
        assert e.ids([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_files(docs, empty):
    plain = library(tokenfiles.VOCABULARY)
    ids = [(i, np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")) for i, t in pairs(docs)]
    out = sorted(tokenfiles.token_roundtrip(docs).collect(), key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in out] == sorted([i for i, _ in ids], key=lambda i: (i is not None, i))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in out], [(i, len(x), zlib.crc32(x.tobytes())) for i, x in ids])
    assert tokenfiles.token_roundtrip(empty).collect() == []


def test_token_files_by_range(tmp_path, monkeypatch):
    """A store that can't be mapped is read by ranges; documents longer than a range come whole."""
    import pyarrow.fs as pafs

    lengths = [0, 3, 0, 50, 1, 7, 0]
    offsets = np.cumsum([0, *lengths]).tolist()
    ids = np.arange(sum(lengths), dtype="<u2")
    (tmp_path / "x.bin").write_bytes(ids.tobytes())
    remote = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    monkeypatch.setattr(tokenfiles, "files_of", lambda folder: (remote, ""))
    monkeypatch.setattr(tokenfiles, "READ_BYTES", 16)
    assert [x.tolist() for x in tokenfiles.part_ids(str(tmp_path), "x.bin", 2, offsets)] == [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_exact_dedup(spark, docs, empty):
    groups = collections.defaultdict(list)
    for i, t in pairs(docs):
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest()].append(i)
    want = []
    for h, members in groups.items():
        k = min((i for i in members if i is not None), default=None)
        want += [(i, k, len(members), i == k, h) for i in members]
    same([tuple(r) for r in cuckoo.exact_dedup(docs).collect()], want)
    assert cuckoo.exact_dedup(empty).collect() == []
    gone = next(iter(groups))
    left = cuckoo.exact_dedup(docs, removed=spark.createDataFrame([(bytes.fromhex(gone),)], "digest binary")).collect()
    assert not any(r.kept for r in left if r.text_sha256 == gone) and any(r.kept for r in left)
    kept = cuckoo.keep_first(docs).collect()
    assert len(kept) == len(groups)


def test_cuckoo_index_deletes_and_grows():
    index, live = cuckoo.CuckooIndex(1), {}
    rng = random.Random(2)
    for n in range(20_000):
        k = hashlib.sha256(b"%d" % rng.randrange(4000)).digest()
        if rng.random() < 0.3:
            assert index.delete(k) == (live.pop(k, None) is not None)
        else:
            index[k] = live[k] = n
    assert len(index) == len(live) and dict(index.items()) == live


def test_simhash(docs, empty):
    from xxhash import xxh64_intdigest

    prints = {}
    for _, t in pairs(docs):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) if x]
        h = [xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[k : k + 3] for k in range(len(w) - 2)] or ([w] if w else []))]
        prints[t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    codes = sorted(set(prints.values()))
    root = {c: c for c in codes}
    for _ in codes:
        for a in codes:
            root[a] = min(root[b] for b in codes if (a ^ b).bit_count() <= 2)
    first = {}
    for i, t in pairs(docs):
        if i is not None:
            first[root[prints[t]]] = min(first.get(root[prints[t]], i), i)
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(i, f"{prints[t]:016x}", first.get(root[prints[t]])) for i, t in pairs(docs)])
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize(("group", "blocks"), [(simhash.GROUP, simhash.BLOCKS), (8, 99), (8, 1)])  # also many blocks, and candidates
def test_near_copies_equal_brute_force(spark, monkeypatch, group, blocks):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    made = []
    for n in [3, 5, 9, 12, 30, 60, 150, 400] * 6:
        base = rng.choices(words, k=n)
        made.append(" ".join(base))
        for edits in (1, 1, 2, 4):  # from copies just above to just below the limit
            copy = list(base)
            for _ in range(max(1, n * edits // 100) if n > 60 else edits):
                copy[rng.randrange(n)] = rng.choice(words)
            made.append(" ".join(copy + rng.choices(words, k=rng.choice((0, 0, n // 12)))))
    line = rng.choices(words, k=40)  # a passage that many share and that few of them differ in by little
    made += [" ".join(line + rng.choices(words, k=rng.randint(4, 20))) for _ in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, made)]
    forest, near = simhash.Forest(len(made)), 0
    for a in range(len(made)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                forest.join(np.array([a]), np.array([b]))
                near += 1
    assert near > 50
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == sorted(set(forest.roots().tolist()))


def test_near_copies_go_through_the_gray_index(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    made = [" ".join(rng.choices("abcdefgh", k=300)) for _ in range(40)]
    made += [t + " z" for t in made[:20]] + [t.upper() for t in made[:10]] + ["", " "]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    fp = np.array([simhash.sketch(simhash.shingle_set(t))[0] for t in made], np.int64).view(np.uint64)
    want, got = simhash.Forest(len(made)), simhash.Forest(len(made))
    want.join(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.LIMIT))
    rows = frame.withColumnRenamed("doc_id", "_row")
    found = simhash.indexed_pairs(simhash.sketches(rows, "text"), f"file://{tmp_path}").collect()
    assert len(found) < len(made) and all(r.u > r.v for r in found)
    got.join(np.array([r.u for r in found]), np.array([r.v for r in found]))
    assert (got.roots() == want.roots()).all() and len(set(got.roots())) < 60
    links, seen = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda nodes, *a: seen.append(nodes.count()) or links(nodes, *a))
    # no bands: what the index proposes is linked all the same
    monkeypatch.setattr(simhash, "likely", lambda pairs, drawn: pairs.limit(0))
    monkeypatch.setattr(simhash, "compare_clusters", lambda members, *a: members.select(F.col("row").alias("u"), F.col("row").alias("v")).limit(0))
    left = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert seen == [len(set(fp.tolist()))]
    assert not left & set(range(60, 70)) and 71 not in left and set(range(20, 40)) <= left


def test_one_row_stays_where_ids_are_null_or_repeat(spark):
    base = [[f"{c}{i}" for i in range(100)] for c in "abc"]
    near = [" ".join(x + [c]) for x in base for c in ("x", "y")]
    ids = [None, None, 1, None, 7, 1]  # by component: null ids alone, one of two ids null, an id that another component has
    frame = spark.createDataFrame(list(zip(ids, near)), "doc_id long, text string")
    left = [(r.doc_id, r.text[:1]) for r in simhash.keep_one(frame).collect()]
    assert sorted(left, key=lambda x: x[1]) == [(None, "a"), (1, "b"), (1, "c")]


def test_gray_index_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), base[:5].repeat(60) ^ rng.integers(0, 64, 300).astype(np.uint64)]))
    monkeypatch.setattr(simhash, "PER_RANGE", 60)
    nodes = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    found = simhash.links(nodes).collect()
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    want, got = simhash.Forest(len(codes)), simhash.Forest(len(codes))
    want.join(a, b)
    u, v = (np.array([r[k] for r in found], np.int64).view(np.uint64) for k in (0, 1))
    assert (np.bitwise_count(u ^ v) > 0).all()
    got.join(np.searchsorted(codes, u), np.searchsorted(codes, v))
    assert (want.roots() == got.roots()).all()


def test_suffix(docs, empty, monkeypatch):
    data = [(i, t.encode()) for i, t in pairs(docs)]
    want = brute_force_repeats(data)
    same([tuple(r) for r in suffix.remove_repeats(docs).collect()], want)
    assert suffix.remove_repeats(empty).collect() == []
    for name, value in (("GROUP_BYTES", 3000), ("STRETCH", 1500), ("PER_BUCKET", 40), ("BYTES_PER_BUCKET", 4000)):  # many groups, stretches and buckets
        monkeypatch.setattr(suffix, name, value)
    same([tuple(r) for r in suffix.remove_repeats(docs).collect()], want)


def brute_force_repeats(data):
    """(id, bytes, removed, spans, hash of what is kept) of each (id, bytes)."""
    seen = collections.Counter(b[s : s + 200] for _, b in data for s in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s] += 1
                gone[s + 200] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((i, len(b), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_with_hot_passages(spark, monkeypatch):
    """Passages shared by nearly all documents: what differs lies before, after, or on both sides of their anchors."""
    rng = random.Random(11)
    long, short = ("".join(rng.choices("abcdefgh ", k=n)) for n in (420, 215))
    heads, tails = ([("".join(rng.choices("ab", k=3)) * rng.randint(1, 20)) for _ in range(12)] for _ in range(2))
    made = [rng.choice(heads) + p + rng.choice(tails) for p in (long, short, long + short) for _ in range(60)] + [short[:203], long[100:330], "x" * 700]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    want = brute_force_repeats([(i, t.encode()) for i, t in enumerate(made)])
    monkeypatch.setattr(suffix, "PER_BUCKET", 30)
    for size in (1 << 14, 1 << 11):
        monkeypatch.setattr(suffix, "BYTES_PER_BUCKET", size)
        same([tuple(r) for r in suffix.remove_repeats(frame).collect()], want)


def test_window_ranks_are_the_order_of_the_bytes():
    data = np.random.default_rng(1).integers(0, 2, 600, dtype=np.uint8)
    data[100:300], data[350:550] = 1, data[:200]
    raw = data.tobytes()
    ranks = suffix.window_ranks(data).tolist()
    want = sorted({raw[i : i + 200].ljust(200, b"\0") for i in range(600)})
    assert ranks == [want.index(raw[i : i + 200].ljust(200, b"\0")) for i in range(600)]


def test_pii(docs, empty):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        n = re.sub("[^0-9]", "", s)
        luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, n[::-1])))
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(n) <= 19 and luhn % 10 == 0, "phone": 9 <= len(n) <= 15}[kind]

    want = {}
    for _, t in pairs(docs):
        want[t] = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if good(k, m.group())]
    out = pii.find_pii(docs).collect()
    by = {i: t for i, t in pairs(docs)}
    for r in out:
        s = want[by[r.doc_id]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in s) for k in kinds)
    assert sum("iban" in r.spans for r in out) == 1 and len(out) == docs.count()
    assert pii.find_pii(empty).collect() == []
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    text = masked.filter(F.contains("text", F.lit("iban"))).first().text
    assert text == "card <CARD> tel <PHONE> iban <IBAN> x"


def test_context_decides(spark):
    """(text, spans, redacted text): words near a span alone add it, remove it and stop its redaction."""
    cases = [
        ("SSN 123-45-6789 ok", "ssn:4:15", "SSN <SSN> ok"),
        ("x 123-45-6789 ok", "", "x 123-45-6789 ok"),
        ("SSN 000-45-6789 ok", "", "SSN 000-45-6789 ok"),
        ("pay DE89370400440532013000", "iban:4:26", "pay <IBAN>"),
        ("example DE89370400440532013000", "", "example DE89370400440532013000"),
        ("example IBAN DE89370400440532013000", "iban:13:35", "example IBAN <IBAN>"),
        ("at 10.2.3.4", "ip:3:11", "at <IP>"),
        ("version 10.2.3.4", "ip:8:16", "version 10.2.3.4"),
        ("version" + " x" * 20 + " 10.2.3.4", "ip:48:56", "version" + " x" * 20 + " <IP>"),
        ("version 1.2.3.4 and then 10.2.3.4", "ip:8:15,ip:25:33", "version 1.2.3.4 and then <IP>"),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: ",".join(x for x in r.spans.split(",") if x[:4] != "card") for r in pii.find_pii(frame).collect()}
    assert [found[i] for i in range(len(cases))] == [c[1] for c in cases]
    assert [r.text for r in pii.redact(frame).orderBy("doc_id").collect()] == [c[2] for c in cases]


def test_many_matches_in_one_text(spark):
    n = 20_000
    text = "é🙂a7@b.cc 1.2.3.4 " * n
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.find_pii(frame).collect()[0]
    assert (row.n_email, row.n_ip) == (n, n)
    joined = ",".join([f"email:{18 * i + 2}:{18 * i + 9}" for i in range(n)] + [f"ip:{18 * i + 10}:{18 * i + 17}" for i in range(n)])
    assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert pii.redact(frame).collect()[0].text == "é🙂<EMAIL> <IP> " * n
    assert time.time() - began < 60


def test_redaction_merges_overlaps(spark):
    rng = random.Random(4)
    made = [" ".join(rng.choices(["+49 30 1234567", "4111 1111 1111 1111", "1.2.3.4", "a@1.2.3.4", "+1.2.3.4", "word", "é" * 900, "12"], k=rng.randint(1, 30))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    scores = {r.doc_id: r.scores for r in pii.find_pii(frame).collect()}
    want = []
    for i, t in enumerate(made):
        out, at = "", 0
        spans = sorted((int(a), int(b), k) for k, a, b, s in (x.split(":") for x in scores[i].split(",") if x) if float(s) >= 0.5)
        for a, b, k in spans:
            if a >= at:
                out += t[at:a] + f"<{k.upper()}>"
            at = max(at, b)
        want.append(out + t[at:])
    assert [r.text for r in pii.redact(frame).orderBy("doc_id").collect()] == want


def test_iban_ends_at_its_length(spark):
    plain = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    after = ["", " Please pay", " Bitte", " 2024", " EUR 50", "\nNEXT 12", " A", ", OK", " DE", "."]
    rows = [(f"IBAN {x}{y}", f"IBAN <IBAN>{y}", f"iban:5:{5 + len(x)}") for x in plain for y in after]
    rows += [(f"{plain[0]} {plain[1]} {plain[2]}", "<IBAN> <IBAN> <IBAN>", "iban:0:22,iban:23:50,iban:51:78")]
    rows += [(x, x, "") for x in ("DE89370400440532013001 Please", "DE893704004405320130007", "XDE89370400440532013000", "DE8937040044053201300 Please")]
    frame = spark.createDataFrame(list(enumerate(x for x, _, _ in rows)), "doc_id long, text string")
    spans = {r.doc_id: ",".join(x for x in r.spans.split(",") if x[:4] == "iban") for r in pii.find_pii(frame).collect()}
    assert [spans[i] for i in range(len(rows))] == [x for _, _, x in rows]
    ibans = {r.doc_id: r.text for r in pii.redact(frame).collect() if "card" not in r.text.lower()}
    assert len(ibans) > 40 and all(ibans[i] == rows[i][1] for i in ibans)


def naive_agenda(codec, segment, key):
    """Merges by scanning all neighbours anew each time; key: None for no dropout."""
    symbols, skipped = [(i, c) for i, c in enumerate(segment)], set()
    while True:
        found = [(codec.order[a + b], i, n) for n, ((i, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in codec.order and (i, a + b) not in skipped]
        if not found:
            return [x for _, x in symbols]
        rank, i, n = min(found)
        piece = symbols[n][1] + symbols[n + 1][1]
        if key is not None and dropout.mix(key + i * 0xD1B54A32D192ED03 + rank * 0x9E3779B97F4A7C15 & (1 << 64) - 1) < codec.below:
            skipped.add((i, piece))
        else:
            symbols[n : n + 2] = [(i, piece)]


def naive_ids(codec, text, draws):
    if not text:
        return []
    key = None if draws is None else dropout.mix(codec.seed + dropout.mix(draws))
    marked = dropout.MARK + text.replace(dropout.MARK, "\0").replace(" ", dropout.MARK)
    out = []
    for m in re.finditer(f"\0|{dropout.MARK}*[^{dropout.MARK}\0]+|{dropout.MARK}+", marked):
        literal = m.group() == "\0"
        for x in [dropout.MARK] if literal else naive_agenda(codec, m.group(), None if key is None else key + m.start() * 0xD1B54A32D192ED03):
            out += [codec.ids[x]] if x in codec.ids and not literal else [codec.bytes[b] for b in x.encode()]
    return out


def random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choices("aeinorst ▁é中\n'" + "aeinorsthe ", k=rng.choice((3, 20, 90)))) for _ in range(n)] + ["international" * 9, "▁", " ", "▁▁ ▁", "\1 x", "▁ \1mark\1 x"]


def test_dropout_equals_a_naive_agenda(monkeypatch):
    codec, made = dropout.Codec(), random_texts(250)
    draws = [random.Random(t).randrange(1 << 64) for t in made]
    want = [naive_ids(codec, t, d) for t, d in zip(made, draws)]
    for short, step in ((dropout.SHORT, dropout.STEP), (6, 16)):  # also most segments one by one, and many steps
        monkeypatch.setattr(dropout, "SHORT", short)
        monkeypatch.setattr(dropout, "STEP", step)
        assert [x.tolist() for x in codec.encode_all(made, draws)] == want
        assert [x.tolist() for x in codec.encode_all(made, None)] == [naive_ids(codec, t, None) for t in made]
    assert codec.encode(made[7], draws[7]).tolist() == want[7]
    assert [codec.decode(x) for x in want] == made


def test_dropout(spark, docs, empty):
    codec = dropout.Codec()
    for _, t in pairs(docs):
        if dropout.MARK not in t:
            assert codec.encode(t, None).tolist() == codec.library.encode(t)
    long = " ".join(["international"] * 300)
    assert len({codec.encode(long, i).tobytes() for i in range(20)}) == 20  # documents differ, and so do the places of one
    assert len(set("\0".join(codec.pieces[i] for i in codec.encode(long, 1)).split(dropout.MARK))) > 20
    assert dropout.Codec(rate=0.0).encode("international news", 3).tolist() == codec.library.encode("international news")
    assert 0.09 < sum(codec._skipped(dropout.mix(k), p, 77) for k in range(200) for p in range(100)) / 20_000 < 0.11
    out = dropout.encode_documents(docs).collect()
    want = collections.Counter()
    for i, t in pairs(docs):
        ids = codec.encode(t, codec.hash(b"%d" % i if i is not None else b"", dropout.SEED))
        want[i, len(ids), zlib.crc32(ids), hashlib.sha256(t.encode()).hexdigest(), True, tuple(ids.tolist())] += 1
    assert collections.Counter((*r[:5], tuple(r.ids)) for r in out) == want
    assert dropout.encode_documents(empty).collect() == []


def test_language_marginal_is_the_sum_over_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    p = np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.15, 0.05])[:, None]
    model = langid.Model(["x"], {x: i for i, x in enumerate(pieces)}, p, np.zeros(1))

    def total(word):
        if not word:
            return 1.0
        return sum(p[i, 0] * total(word[len(x) :]) for i, x in enumerate(pieces) if word.startswith(x)) + (0 if word[0] in pieces else p[-1, 0] * total(word[1:]))

    for w in ("▁ab", "▁abab", "▁bca", "▁c"):
        assert np.exp(model.log_word(w)[0]) == pytest.approx(total(w))


def exact_log(word, pieces, p):
    """Log of the sum over all segmentations in fractions, by a forward pass; p's last entry is an unknown letter's."""
    from fractions import Fraction
    from math import log

    value = {x: Fraction(float(v)) for x, v in zip(pieces, p)}
    forward = [Fraction(1)]
    for end in range(1, len(word) + 1):
        own = [forward[a] * value[word[a:end]] for a in range(max(0, end - 6), end) if word[a:end] in value]
        forward.append(sum(own) + (0 if word[end - 1 : end] in value else forward[end - 1] * Fraction(float(p[-1]))))
    return log(forward[-1].numerator) - log(forward[-1].denominator)


def test_long_words_and_many_words_at_once():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aab"]
    rng = np.random.default_rng(4)
    table = rng.random((len(pieces) + 1, 2)) * np.array([1, 1e-9])  # two languages, one of tiny probabilities
    model = langid.Model(["x", "y"], {x: i for i, x in enumerate(pieces)}, table, np.zeros(2))
    words = ["▁" + "".join(rng.choice(list("abc"), n)) for n in (1, 2, 5, 22, 23, 24, 25, 48, 49, 500)] + ["▁" + "a" * 60]
    found = model.log_words(words)
    assert found == pytest.approx(np.array([[exact_log(w, pieces, table[:, k]) for k in (0, 1)] for w in words]), rel=1e-9)
    assert np.array([model.log_word(w) for w in words]) == pytest.approx(found)


def test_fit_is_expectation_maximisation():
    """One round against expected counts over written-out segmentations."""
    pieces, words = ["▁", "▁a", "a", "b", "ab"], {"▁ab": 3, "▁aab": 2, "▁bxa": 1}

    def all_ways(word):
        if not word:
            return [[]]
        own = [[x, *rest] for x in pieces if word.startswith(x) for rest in all_ways(word[len(x) :])]
        return own + ([] if word[0] in pieces else [["?", *rest] for rest in all_ways(word[1:])])

    p = {x: 4.0 ** len(x) for x in pieces} | {"?": 1e-6}
    p = {x: v / sum(p.values()) for x, v in p.items()}
    for _ in range(2):
        expected = collections.Counter()
        for w, n in words.items():
            ways = [(np.prod([p[x] for x in way]), way) for way in all_ways(w)]
            for v, way in ways:
                for x in way:
                    expected[x] += n * v / sum(u for u, _ in ways)
        p = {x: expected[x] + (langid.UNKNOWN if x == "?" else langid.FLOOR) for x in p}
        p = {x: v / sum(p.values()) for x, v in p.items()}
    model = langid.fit({"x": words}, {"x": 1}, pieces, rounds=2)
    assert model.probabilities[:, 0] == pytest.approx([*map(p.get, pieces), p["?"]])


def test_words_are_letters():
    assert langid.words_of("½ ² ① x² Ⅷ é1ß a_b") == ["▁x", "▁é", "▁ß", "▁a", "▁b"]


def test_language_id(spark, docs, empty):
    rows = [(i, ("the thing is there and with this " if i % 2 else "der das und nicht eine schön ist ") * (1 + i % 5), "en" if i % 2 else "de", "s", 1, "d", 1, 1) for i in range(60)]
    known = spark.createDataFrame(rows + [(100, None, "en", "", 0, "", 0, 0), (101, "12 !!", "de", "", 0, "", 0, 0), (102, "q" * 9000, None, "", 0, "", 0, 0)], SCHEMA)
    out = {r.doc_id: r for r in langid.identify(known).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert (out[100].lang_pred, out[100].score, out[101].lang_pred) == ("und", 0.0, "und") and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert langid.identify(empty).collect() == [] and langid.identify(docs).count() == docs.count()


def test_media(docs, empty):
    want = []
    for i, t in pairs(docs):
        b = t.encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    out = media.media_roundtrip(docs).collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out], want)
    by = {x[3]: x for x in ((*w, t.encode()) for w, (_, t) in zip(want, pairs(docs)))}
    for r in out:
        payload = by[r.payload_sha256][5].ljust(r.payload_bytes, b"\0")
        stored = media.encode_png(payload)
        p = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
        mean, seen = sum(payload) / len(payload), p[p > 0]
        text = f"mean={mean:.3f};std={math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload)):.3f};entropy={abs(sum(seen * np.log2(seen))):.3f}"
        assert (r.media_bytes, r.media_sha256, r.length) == (len(stored), hashlib.sha256(stored).hexdigest(), len(stored))
        assert r.feature == f"png:64x{len(payload) // 64}x8;{text}" and (r.width, r.height, r.depth, r.digest) == (64, len(payload) // 64, 8, r.payload_sha256)
    assert len({(r.shard, r.offset) for r in out}) == len({t.rstrip("\0") for _, t in pairs(docs)})
    assert media.media_roundtrip(empty).collect() == []


def test_media_rows_point_into_the_shards(spark, docs):
    import tarfile

    folder = shared_dir(spark, "media-test")
    _, placed = media.media_table(docs, folder)
    for r in placed.collect():
        path = f"{folder.removeprefix('file://')}/shards/{r.shard}"
        with tarfile.open(path) as tar:  # any tar reader finds the payload under its digest
            stored = tar.extractfile(f"{bytes(r.digest).hex()}.png").read()
        with open(path, "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length) == stored
        assert hashlib.sha256(media.decode_png(stored)).digest() == r.digest
        assert (r.width, r.height, r.depth) == media.png_header(stored[: media.HEADER_BYTES])


def test_media_disk_beside_the_shards(spark):
    """Bytes a payload that are shuffled, or written beside the shards, on top of what few rows take."""
    from pathlib import Path

    shared, context = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")), spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    def taken(n):
        rng, known, moved = random.Random(n), set(shared.iterdir()), shuffled()
        rows = [(i, rng.randbytes(rng.randint(1, 90)).hex()) for i in range(n)]
        assert len(media.media_roundtrip(spark.createDataFrame(rows, "doc_id long, text string").cache()).collect()) == n
        (folder,) = set(shared.iterdir()) - known
        return shuffled() - moved, sum(f.stat().st_size for f in folder.glob("*/*.parquet"))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        (moved, written), (more_moved, more_written) = taken(1000), taken(9000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (more_moved - moved) / 8000 < 420 and (more_written - written) / 8000 < 130, ((more_moved - moved) / 8000, (more_written - written) / 8000)


def test_warc(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/é b", big, "z"), (2, None, big, "z"), (5, "u", big, "z"), (5, "u", big, "z"), (None, "n", big, "z"), (3, "u", "small", "z"), (4, "u", "small", "z"), (6, "u", None, "z"), (7, "u", "a\r\n\r\nb", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if h == big and i != 5 else "response", 5 if h == big and i != 5 else None) for i, _, h, _ in rows]
    same([tuple(r)[:5] for r in warc.archive_roundtrip(pages).collect()], want)
    assert warc.archive_roundtrip(pages.limit(0)).collect() == []


def test_zip_directory(tmp_path, monkeypatch):
    import zipfile

    path = tmp_path / "a.zip"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # sizes and offsets beyond this need ZIP64 fields
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5):
            z.writestr(f"m{k}", b"%d" % k * 400)
    with path.open("rb") as f:
        found = warc.directory(f, path.stat().st_size)
        assert [m.name for m in found] == [f"m{k}" for k in range(5)]
        for k, m in enumerate(found):
            f.seek(warc.member_start(f, m))
            assert f.read(m.stored) == b"%d" % k * 400


def test_pipeline_stages_on_odd_rows(spark, docs, empty, tmp_path):
    """Null ids, repeated rows, null and empty texts and extra columns; and no rows at all."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    every = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert not collections.Counter(tuple(r) for r in out.collect()) - collections.Counter(every)
        none = stage(spark, empty, str(tmp_path))
        assert none.columns == docs.columns and none.collect() == []
    assert stages["packing"](spark, empty, str(tmp_path)).collect() == []
    groups = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in every}
    assert stages["exact_dedup"](spark, docs, str(tmp_path)).count() == len(groups)
    assert stages["pii"](spark, docs, str(tmp_path)).filter("text is null").count() == sum(r[1] is None for r in every)
    known = stages["language_id"](spark, docs, str(tmp_path)).collect()
    assert known and all(any(c.isalpha() for c in r.text) for r in known)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, str(tmp_path))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert 0 < after.count() <= left.count()
        left = after
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in left.collect()}
    assert not left.filter("text is null or text rlike '@c.de'").count()
