"""Small cases held against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import re
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import decontaminate, jaccard, lines, matroska, mixing, quality, repair, separators, substrings, urls
from corpusframe.llm.common import hash_spans, slices, word_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"
WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    shared = passage(1, 60)
    out = [(i, f"{passage(100 + i, 40)}\n{shared}\n{passage(200 + i, 30)}", "en", f"s{i % 3}") for i in range(8)]
    near = passage(3, 300)
    out += [(20, near, "en", "s0"), (21, near.replace("w7 ", "w9 "), "en", None), (22, near, "fr", "s9")]
    out += [(30, None, None, None), (31, "", "en", ""), (32, "one", "en", "s1"), (33, " \t\n ", "en", "s1"), (34, "a b c", "de", "s2"), (35, "A b\tc", "de", "s2")]
    out += [(40, passage(5, 3000), "en", "s4"), (41, "x" * 500 + " " + "é" * 70, "en", "s4"), (3, out[3][1], "en", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a b", None, "", " é\tx" + "y" * 90, "b"]
    for limit in (1, 4, 1000):
        found = []
        for _, _, data, offsets in slices(pa.array(texts), limit):
            s, e, first = word_spans(data, offsets)
            h = hash_spans(data, s, e)
            found += [[(data[a:b].tobytes().decode(), int(x)) for a, b, x in zip(s[lo:hi], e[lo:hi], h[lo:hi])] for lo, hi in zip(first[:-1], first[1:])]
        assert [[w for w, _ in f] for f in found] == [words(t) for t in texts]
        assert found[0][1] == found[4][0]


def test_media(docs, rows, empty):
    got = {(r.doc_id, r.payload_sha256): r for r in matroska.media_digest(matroska.encode_media(docs)).collect()}
    for doc_id, text, *_ in rows:
        n, payload = matroska.pad(text)
        r = got[doc_id, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-16:]))
        assert len(payload) % 192 == 0 and payload
    table = matroska.packets(matroska.encode_media(docs.filter("doc_id = 40")))
    assert table.agg(F.sum("byte_length")).first()[0] == len(matroska.pad(passage(5, 3000))[1])
    assert matroska.media_digest(matroska.encode_media(empty)).count() == 0


@pytest.mark.parametrize("lacing", list(matroska.LACINGS))
@pytest.mark.parametrize("n", [1, 192, 192 * 9, 192 * 2500, 1000])
def test_lacing_round_trip(lacing, n):
    payload = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    media = matroska.write_media(payload, lacing=lacing)
    found, cues = matroska.read_media(media)
    assert b"".join(media[p["byte_start"] : p["byte_start"] + p["byte_length"]] for p in found.to_pylist()) == payload
    assert cues[0][0] == 0 and media[cues[0][1] : cues[0][1] + 4] == matroska.CLUSTER.to_bytes(4, "big")
    assert found["timestamp_ns"].to_pylist() == [24_000_000 * k for k in range(len(found))]


def test_times_come_from_the_file():
    m = matroska
    block = lambda track, at, kind, frames: m.vint(track) + at.to_bytes(2, "big") + bytes([0x80 | kind << 1]) + m.lace(frames, kind)
    three = [b"a" * 300, b"bb", b"ccc"]

    def media(scale, default):
        tracks = m.element(m.TRACKS, b"".join(m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, t) + (m.number(m.DEFAULT_DURATION, d) if d else b"")) for t, d in default.items()))
        cluster = m.number(m.TIMESTAMP, 50) + m.element(m.SIMPLE_BLOCK, block(1, 7, 1, three)) + m.element(m.SIMPLE_BLOCK, block(2, 9, 3, three))
        cluster += m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(1, 20, 3, three)) + m.number(m.BLOCK_DURATION, 6)) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(2, 21, 0, [b"x"])) + m.element(m.REFERENCE, b"\x01"))
        info = m.element(m.INFO, m.number(m.SCALE, scale)) if scale else m.element(m.INFO, b"")
        return m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.CLUSTER, cluster) + info + tracks)

    table, cues = m.read_media(media(500_000, {1: 2_000_000, 2: 0}))
    rows = table.to_pylist()
    assert [r["track"] for r in rows] == [1, 1, 1, 2, 2, 2, 1, 1, 1, 2] and cues == []
    assert [r["timestamp_ns"] for r in rows] == [28_500_000, 30_500_000, 32_500_000, 29_500_000, None, None, 35_000_000, 36_000_000, 37_000_000, 35_500_000]
    assert [r["duration_ns"] for r in rows] == [2_000_000] * 3 + [None] * 3 + [1_000_000] * 3 + [None]
    assert [r["keyframe"] for r in rows] == [True] * 9 + [False] and [r["byte_length"] for r in rows[:3]] == [300, 2, 3]
    assert m.read_media(media(None, {}))[0]["timestamp_ns"][0].as_py() == 57_000_000
    whole = m.write_media(b"z" * 2000)
    for end in range(1, len(whole), 7):
        with pytest.raises(ValueError):
            m.read_media(whole[:end])


def test_null_media(spark):
    frame = spark.createDataFrame([(1, 4, None), (None, 3, bytearray(matroska.write_media(b"abc")))], "doc_id long, n_bytes long, media binary").withColumn("packets", F.lit(1))
    got = sorted(matroska.media_digest(frame).collect(), key=lambda r: r.n_bytes)
    assert got[0].payload_bytes == 3 and got[0].doc_id is None and got[1].payload_sha256 is None and got[1].doc_id == 1
    assert [(r.doc_id, r.packet_no, r.byte_length) for r in matroska.packets(frame).collect()] == [(None, 0, 3)]


def removed(rows, window):
    seen, out = {}, {}
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0], r[1] or ""))
    for doc_id, text in order:
        w = words(text)
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), (doc_id, k))
    for doc_id, text in order:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < (doc_id, k):
                gone[k : k + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("group_rows,hot", [(1, 500), (20_000, 500), (20_000, 2)])
@pytest.mark.parametrize("window", [5, 20])
def test_substrings(docs, rows, empty, window, group_rows, hot, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(substrings, "HOT", hot)
    want = removed(rows, window)
    got = substrings.without_repeats(docs, window).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert any(v[1] for v in want.values())
    assert substrings.without_repeats(empty).count() == 0


def kept_lines(rows):
    """Brute force of the chunk rule: which lines go, by the bytes of all chunks."""
    import pyarrow as pa

    order = lambda doc_id: lines.NO_ID if doc_id is None else doc_id
    found, first_at = [], {}
    for doc_id, text in rows:
        own = (text or "").encode().split(b"\n")
        _, _, data, offsets = next(slices(pa.array([text or ""])))
        starts, ends, first = lines.line_spans(data, offsets)
        stop = lines.boundaries(hash_spans(data, starts, ends), first)
        spans = set()
        for i in range(len(own) - 1):
            j = i + 1
            while not stop[j] and j + 1 < len(own) and j - i + 1 < lines.MAX_LINES:
                j += 1
            spans.add((i, j))
        for j in range(1, len(own)):
            i = j - 1
            while not stop[i] and i > 0 and j - i + 1 < lines.MAX_LINES:
                i -= 1
            spans.add((i, j))
        for i, j in spans:
            body = tuple(own[i : j + 1])
            first_at[body] = min(first_at.get(body, (lines.NO_ID, 1 << 30)), (order(doc_id), i))
        found.append((doc_id, own, spans))
    out = []
    for doc_id, own, spans in found:
        gone = {k for i, j in spans if first_at[tuple(own[i : j + 1])] < (order(doc_id), i) for k in range(i, j + 1)}
        left = b"\n".join(x for k, x in enumerate(own) if k not in gone)
        out.append((doc_id, len(own), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def test_lines(spark, empty, tmp_path):
    rng = np.random.default_rng(5)
    rows, planted, caught = [], {}, {}
    for n in range(2, 8):
        for k in range(24):
            block = [passage(1000 * n + k, int(rng.integers(1, 30))) + f" {n} {k}"] + [f"shared {n} {k} {j} é" for j in range(n - 1)]
            for copy in range(3):
                planted[n] = planted.get(n, 0) + (copy > 0)
                rows.append((len(rows), "\n".join([f"own {n} {k} {copy} {j}" for j in range(int(rng.integers(1, 9)))] + block + [f"end {n} {k} {copy} {j}" for j in range(int(rng.integers(1, 9)))])))
    last = len(rows)
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a\na\na\na"), (1004, "x\na\na"), (None, "p\nq"), (1005, "p\nq"), (0, rows[0][1]), (1006, "one line"), (1007, "one line"), (0, "own text\n" + rows[0][1]), (2**63 - 1, "p\nq\nr"), (1008, "same\n" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("order", F.lit(1)).withColumn("first", F.lit("x"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = kept_lines(rows)
    got = lines.without_repeated_lines(frame, True).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(repr, want))
    by_id = {r.doc_id: r.n_removed for r in got}
    for i in range(last):
        n = 2 + i // 72
        caught[n] = caught.get(n, 0) + (i % 3 > 0 and by_id[i] == n)
        assert i == 0 or by_id[i] <= n  # id 0 is given to several rows
    assert all(caught[n] / planted[n] >= share for n, share in ((2, 0.9), (3, 0.95), (4, 0.95), (5, 0.95), (6, 0.95), (7, 0.95))), (caught, planted)
    assert lines.op5_lines(spark, str(tmp_path)).count() == len(rows)
    assert lines.without_repeated_lines(empty).count() == 0


def test_boundaries_move_with_the_text():
    import pyarrow as pa

    text = "\n".join(f"line {i}" for i in range(200))
    cuts = []
    for front in ("", "one\n", "one\ntwo\nthree\n"):
        _, _, data, offsets = next(slices(pa.array([front + text])))
        starts, ends, first = lines.line_spans(data, offsets)
        cuts.append(lines.boundaries(hash_spans(data, starts, ends), first)[-199:].tolist())
    assert cuts[0] == cuts[1] == cuts[2] and 175 < sum(cuts[0]) < 199


def test_lines_whose_hashes_clash_stay(spark, monkeypatch):
    flat = lambda data, starts, ends: np.minimum(ends - starts, 3).astype(np.uint64)
    monkeypatch.setattr(lines, "hash_spans", flat)
    frame = spark.createDataFrame([(0, "a\nb\nwww"), (1, "a\nc\nwww"), (2, "\n\nxyz"), (3, "\n\nxyz")], "doc_id long, text string")
    run = {r.doc_id: r.n_removed for r in lines.without_repeated_lines(frame).collect()}
    assert run[0] == run[1] == 0 and run[2] == 0


ODD = ["a  b", "a \nb", "a   b", " x ", "\n\n a\n", "x\n\ny", "it's don't 's", "a \n \n b", "é ñ\tz", "a b　c", "end. <|endoftext|> b", "", "x\r\ny z", "a\x1c b", "a\n b", " a b"]


def encoded(encoder, texts, limit=1 << 20):
    """Little-endian ids of each text."""
    import pyarrow as pa

    return [ids[a:b].astype("<u4").tobytes() for _, _, ids, edges in encoder.encode(pa.array(texts, pa.string()), limit) for a, b in zip(edges[:-1], edges[1:])]


def test_encoder_and_grammar(tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    encoder, whole = repair.Encoder(repair.default_tokenizer()), Tokenizer.from_file(repair.default_tokenizer())
    texts = [*ODD, passage(9, 500)]
    assert encoder.by_pieces
    for limit in (1, 9, 1 << 20):
        for text, ids in zip(texts, encoded(encoder, texts, limit)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    import json

    made = json.loads(whole.to_str())
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(made))
    other = repair.Encoder(str(tmp_path / "other.json"))  # encodes whole texts
    assert not other.by_pieces
    for text, ids in zip(texts, encoded(other, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
    encoder._forget()
    monkeypatch.setattr(repair, "KNOWN", 2)
    assert list(encoded(encoder, texts, 40)) == list(encoded(encoder, texts))
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(20_000) < 0.01, repair.END_ID, rng.integers(3, 20, 20_000)).astype(np.uint32)
    ids[-1] = repair.END_ID
    sizes = np.diff(np.concatenate(([0], np.flatnonzero(ids == repair.END_ID) + 1))).tolist()
    shard = repair.Shard(repair.pack(ids, sizes, 50_257))
    assert (shard.ids() == ids).all() and len(shard.rules) and len(shard.seq) < 0.6 * len(ids)
    ends = np.cumsum(sizes)
    for k in range(0, len(sizes), 7):
        assert (shard.document(k) == ids[ends[k] - sizes[k] : ends[k]]).all()


def test_encoder_cuts_at_marks_and_keeps_what_comes_again(tmp_path, monkeypatch):
    """A word is encoded once with whatever mark behind it, and pieces that come again outlive a full memory; ids are the library's."""
    import json

    from tokenizers import Tokenizer

    encoder, whole = repair.Encoder(repair.default_tokenizer()), Tokenizer.from_file(repair.default_tokenizer())
    rng = np.random.default_rng(11)
    parts = ["a", "Zz", "don't", "'s", "'", "9", "12.5", ".", ",", ";:", "!", "?!", "...", "é", "ß", "…", "日本", "²", "x.y", " ", "  ", "\n", "\t", "\u00a0", "(", ")", "<|endoftext|>", "<|", "#", "\u0301"]
    texts = ["".join(rng.choice(parts, 12)) for _ in range(3000)]
    for limit in (1 << 12, 1 << 20):
        for text, ids in zip(texts, encoded(encoder, texts, limit)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)

    learnt, plain = [], encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda pieces: learnt.extend(pieces.to_pylist()) or plain(pieces))
    monkeypatch.setattr(repair, "KNOWN", 20)
    encoder._forget()
    slices_ = [" common words, again: " + " ".join(f"rare{k}x{j}" for j in range(8)) + " common. words! again?" for k in range(9)]
    got = encoded(encoder, slices_, 1)  # a slice a text
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in whole.encode_batch(slices_, add_special_tokens=False)]
    assert [learnt.count(w) for w in (b" common", b" words", b" again")] == [1, 1, 1] and learnt.count(b" rare3x1") == 1
    assert len(encoder.known) <= 20 + 8

    made = json.loads(whole.to_str())
    made["added_tokens"].append(made["added_tokens"][0] | {"id": len(whole.get_vocab()), "content": "end.of"})
    (tmp_path / "marked.json").write_text(json.dumps(made))
    marked = repair.Encoder(str(tmp_path / "marked.json"))
    assert not marked.by_pieces
    assert [np.frombuffer(x, "<u4").tolist() for x in encoded(marked, ["the end.of it"])] == [marked.tokenizer.encode("the end.of it", add_special_tokens=False).ids]


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(4)
    block = rng.integers(3, 50_000, 300)
    parts = [np.concatenate((block, rng.integers(3, 50_000, 3), [repair.END_ID])) for _ in range(60)]
    ids = np.concatenate(parts).astype(np.uint32)
    shard = repair.Shard(repair.pack(ids, [len(p) for p in parts], 50_257))
    assert (shard.ids() == ids).all() and (shard.document(17) == parts[17]).all()
    seq = shard.seq.astype(np.int64)
    inner = (seq[:-1] != repair.END_ID) & (seq[1:] != repair.END_ID)
    assert np.unique((seq[:-1] << 32 | seq[1:])[inner], return_counts=True)[1].max() < repair.LEAST
    assert len(seq) < 60 * 8  # the passage is one symbol or few


def test_token_files_and_counts(docs, rows, empty, spark, tmp_path):
    encoder = repair.Encoder(repair.default_tokenizer())
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    start, want = 0, []
    for (doc_id, *_), ids in zip(ordered, encoded(encoder, [r[1] or "" for r in ordered])):
        full = ids + b"\x02\0\0\0"
        want.append((doc_id, start, len(full) // 4, zlib.crc32(full)))
        start += len(full) // 4
    assert sorted(tuple(r) for r in repair.token_files(docs).collect()) == sorted(want)
    assert repair.token_files(empty).count() == 0
    for block in (5, 1 << 16):
        got = sorted(tuple(r) for r in separators.token_counts(docs.coalesce(1), block_ids=block).collect())
        as_read = encoded(encoder, [r[1] or "" for r in rows])
        assert [r[3] for r in got] == [len(x) // 4 + 1 for x in as_read]
    flat = np.array([5, 2, 2, 7, 7, 7, 2, 9], "<u4")
    blocks = spark.createDataFrame([(0, k, 4, bytearray(flat[2 * k : 2 * k + 2].tobytes())) for k in range(4)], "file_no int, block_no long, width int, ids binary")
    assert sorted(tuple(r)[1:] for r in separators.scan(blocks, 2).collect()) == [(0, 0, 2), (1, 2, 1), (2, 3, 4), (3, 7, 1)]


def test_token_counts_belong_to_documents(docs, rows, empty, spark, tmp_path):
    encoder = repair.Encoder(repair.default_tokenizer())
    more = [(100, "# a heading\n## another #"), (101, "#"), (102, "###"), (None, "no id"), (103, "# " * 40), (104, "ends <|endoftext|> or not<|endoftext|>"), (105, "# Title of a page\nC# code, issue#12"), (106, passage(8, 900))]
    assert encoded(encoder, ["#"]) == [b"\x02\0\0\0"]  # a text may hold id 2
    everything = [(r[0], r[1]) for r in rows] + more
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted((-1 if i is None else i, len(x) // 4 + 1) for (i, _), x in zip(everything, encoded(encoder, [t or "" for _, t in everything])))
    for parts, block in ((1, 5), (3, 64), (7, 1 << 16)):
        got = separators.token_counts(frame.repartition(parts), block_ids=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
        for file in {r.file_no for r in got}:
            own = sorted((r.doc_no, r.start, r.n_tokens) for r in got if r.file_no == file)
            assert [r[0] for r in own] == list(range(len(own))) and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
    named = frame.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert sorted((int(r.doc_id or -1), r.n_tokens) for r in separators.token_counts(named).collect()) == want
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in separators.op6_token_counts(spark, str(tmp_path)).collect()) == want
    assert separators.token_counts(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix_table(docs, block=16).collect()
    again = mixing.mix_table(docs, block=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    size = {}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len(words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(size.values()))))
    assert sum(want.values()) == pytest.approx(sum(size.values()))
    by_id = {r.doc_id: r for r in got}
    taken = dict.fromkeys(names, 0)
    for doc_id, text, _, source in rows:
        r = by_id[doc_id]
        assert (r.size, r.source_size) == (len(words(text)), size[source]) and r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[source])
    sources = {r[0]: r[3] for r in rows}
    for r in got:
        taken[sources[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(16, 0.1 * want[s])
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    copies = mixed.collect()
    assert sum(len(words(r.text)) for r in copies) == sum(r.taken for r in got)
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, set()).add(text)
    whole = [r for r in copies if len(words(r.text)) == by_id[r.doc_id].size]
    assert any("\n" in r.text for r in whole) and all(r.text in texts[r.doc_id] for r in whole)
    assert all(all(any(line in t for t in texts[r.doc_id]) for line in r.text.split("\n")[:1]) for r in copies if len(words(r.text)) <= 16)
    assert mixing.mix_table(empty).count() == 0


def test_targets():
    assert mixing.targets([10, 10, 1000], [1, 2, 3], 1020) == pytest.approx([30, 30, 960])
    assert mixing.targets([], [], 0) == []
    assert sorted(mixing.permute(np.arange(37), 37, 5).tolist()) == list(range(37))


def test_quality(spark, empty):
    rng = np.random.default_rng(1)
    data = []
    for i in range(240):
        good = i % 3 > 0
        body = " ".join("".join(rng.choice(list("aeiounrst"), 5)) + ("" if good else "***") for _ in range(int(rng.integers(4, 80))))
        data.append((i, body, int(good)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data] + [(2, None)], "doc_id long, quality int")
    parameters = quality.train(frame, labels)
    scored = {r.doc_id: r.score for r in quality.score(frame, parameters).collect()}
    assert len(scored) == 242 and all(0 <= s <= 1 for s in scored.values()) and scored[900] == scored[901]
    held = [(i, g) for i, _, g in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([(scored[i] >= 0.5) == bool(g) for i, g in held]) > 0.9
    assert quality.score(empty.select("doc_id", "text"), parameters).count() == 0
    constant = quality.train(frame, labels.limit(0))
    assert {r.score for r in quality.score(frame, constant).select("score").collect()} == {0.5}


def test_gradient():
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["out"] += 0.3
    net.p["bias"] += 0.05  # away from the kink that windows of padding have at 0
    texts = [b"hello world " * 40, b"***%%%" * 3, b"zz"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data, y, w = np.frombuffer(b"".join(texts), np.uint8), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        p = net.score(data, offsets)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * (net.p["out"] ** 2).sum()

    g = net.gradient(data, offsets, y, w)
    for name, at in (("out", 3), ("out_bias", 0), ("bias", 2), ("conv", (1, 3, 2)), ("embed", (ord("l"), 1))):
        old, step = net.p[name][at], 1e-5
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-5)


def brute_groups(rows, k, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile_rows", [3, 2_000])
def test_jaccard(spark, docs, rows, empty, tile_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
    got = jaccard.jaccard_groups(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == brute_groups(rows, 4, 85)
    rng = np.random.default_rng(4)
    base = passage(77, 120).split()
    chain = []
    for i in range(40):  # each a few words from the one before: a chain of links
        for j in rng.integers(0, 120, 1):
            base[j] = f"z{i}"
        chain.append((i, " ".join(base)))
    frame = spark.createDataFrame(chain, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        assert {r.doc_id: tuple(r)[1:] for r in jaccard.jaccard_groups(frame, k, percent).collect()} == brute_groups(chain, k, percent)
    assert jaccard.jaccard_groups(empty).count() == 0
    kept = {r.doc_id for r in jaccard.one_of_each_group(docs).collect()}
    assert {30, 31, 20, 34} <= kept and not {22, 35} & kept


@pytest.mark.parametrize("kind,ids", [("bigint", [2**60 + 1, None, 2**63 - 1]), ("smallint", [3, None, -2]), ("decimal(20,2)", [Decimal("12345678901234567.25"), Decimal("2"), None]), ("string", ["a", None, ""]), ("int", [1, 2, 3])])
def test_item_ids_stay_exact(spark, kind, ids):
    texts = [f"{passage(900 + k, 30)} {k}" for k in range(3)]
    benchmark = spark.createDataFrame(list(zip(ids, texts)), f"item_id {kind}, text string")
    frame = spark.createDataFrame([(2**60 + 1 + k, t) for k, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    got = decontaminate.leaks(frame, benchmark)
    assert got.schema["item_id"].dataType == benchmark.schema["item_id"].dataType
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(2**60 + 1 + k, i) for k, i in enumerate(ids)} | {(None, ids[0])}


@pytest.mark.parametrize("shard_items,pass_bytes", [(1, 1), (1, 128 << 20), (20_000, 1)])
def test_decontamination(spark, empty, shard_items, pass_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard_items)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    items = [(1, "What color is the tallest tower of glass? It is deep purple with silver lines."), (2, passage(50, 40) + ". " + passage(51, 12)), (3, None), (4, "!!"), (5, "short one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, passage(60, 90) + " " + items[0][1].upper() + " " + passage(61, 90)), (2, passage(62, 300) + "\n" + items[1][1]), (3, items[1][1][:60]), (4, passage(63, 500)), (5, None), (6, ""), (7, items[0][1].split("?")[0] + "? " + passage(64, 60))]
    changed = items[1][1].split()
    changed[5] = "other"
    rows.append((8, passage(65, 1000) + " " + " ".join(changed)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()}
    assert got == {(1, 1), (2, 2), (8, 2)}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(frame, benchmark).collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(frame, benchmark.limit(0)).count() == 0


def test_block_max_search_equals_scoring_all():
    rng = np.random.default_rng(8)
    items = [passage(300 + i, int(rng.integers(8, 50))) for i in range(30)]
    rows = []
    for i, text in enumerate(items):
        term, tf = np.unique(decontaminate.tokens_of(text), return_counts=True)
        weights = rng.random(len(term)) * tf
        rows.append({"item_id": i, "text": text, "length": len(text.split()), "terms": [{"term": int(t), "weight": float(w)} for t, w in zip(term.view(np.int64), weights)], "total": float(weights.sum())})
    shard = decontaminate.Shard.build(rows)
    texts = [f"{passage(i, 70)} {items[i % 30]} {passage(i + 1, 33 * (i % 4))}" for i in range(40)] + ["", items[3]]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    order = sorted(range(30), key=lambda i: (rows[i]["length"], str(i), rows[i]["text"]))
    got = {(t, order[i]) for t, _, i, *_ in shard.search(*decontaminate.tokens(np.frombuffer(b"".join(raw), np.uint8), offsets), 0.6)}
    want = set()
    for t, text in enumerate(texts):
        w = decontaminate.tokens_of(text)
        for lo in range(0, max(1, len(w) - shard.longest), shard.longest):
            part = w[lo : lo + 2 * shard.longest]
            for i, r in enumerate(rows):
                score = sum(x["weight"] for x in r["terms"] if np.int64(x["term"]).view(np.uint64) in part) / r["total"]
                shares = [max(np.isin(decontaminate.triples(decontaminate.tokens_of(p)), decontaminate.gram_hashes(part, k)).mean() for k in (1, 2, 3)) if len(part) > 2 else 0 for p in decontaminate.question_answer(r["text"])]
                if score >= 0.6 and min(shares) >= 0.5:
                    want.add((t, i))
    assert got == want and len(want) > 30


class PlainUrls:
    """Segmentation by trying every split, and naive Bayes in dictionaries."""

    def __init__(self, counts, rows, prior=0.0):
        """``rows``: host, path, verdict of a rule or None."""
        self.counts, self.total = counts, sum(counts.values()) + 1
        n = {"allow": {}, "block": {}}
        seen = {"allow": 0, "block": 0}
        for host, path, verdict in rows:
            if verdict:
                seen[verdict] += 1
                for w in self.words(host, path):
                    n[verdict][w] = n[verdict].get(w, 0) + 1
        size = {k: sum(n[k].values()) for k in n}
        self.two = min(size.values()) > 0
        self.prior = (math.log(seen["block"] / seen["allow"]) if prior is None else prior) if self.two else 1.0 if seen["block"] else -1.0
        rate = lambda w, k: (n[k].get(w, 0) + urls.EVIDENCE * size[k] / sum(size.values())) / size[k]
        self.weight = lambda w: round((math.log(rate(w, "block")) - math.log(rate(w, "allow"))) * 1e9)

    def cost(self, word):
        n = self.counts.get(word)
        return math.log(self.total) + urls.LETTER * len(word) if n is None else math.log(self.total / n)

    def split(self, name):
        best = {0: (0.0, ())}
        for end in range(1, len(name) + 1):
            best[end] = min(((best[k][0] + self.cost(name[k:end]), best[k][1] + (name[k:end],)) for k in range(end)), key=lambda x: (round(x[0], 9), [-len(w) for w in x[1][::-1]]))
        return best[len(name)][1]

    def words(self, host, path):
        out = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for piece in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", text):
                out += [f"{mark}{len(piece)} digits"] if piece[0].isdigit() else [mark + w for w in self.split(piece)]
        return out

    def score(self, host, path):
        return self.prior + (sum(map(self.weight, self.words(host, path))) / 1e9 if self.two else 0)


def test_url_rules(spark):
    names = ["https://WWW.Example.com:80/en/7?q", "http://a.example.net/de/8x", "https://b.net/de/1", "ftp://x.org/es/", "no scheme", None, "https://notcom/en/", "http://spam-cheap.example.org/en/1", "https://com/en/#top", "://", "https://h?x/y"]
    pages = spark.createDataFrame([(i, u, "<p>cheap spam words here</p><script>var cheap</script>", "x") for i, u in enumerate(names)], "page_id long, url string, html string, host string")
    counts = {r.word: r.n for r in urls.word_counts(pages).collect()}
    assert counts["cheap"] == len(names) and "var" not in counts
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert (got[0].host, got[0].path) == ("www.example.com:80", "/en/7")
    assert [got[i].rule for i in range(len(names))] == [None, "example.net/de/8", "net/de/", "org/es/", None, None, None, None, "com/en/", None, None]
    assert (got[4].host, got[4].path, got[5].host, got[10].host, got[10].path) == ("", "", "", "h", "")
    assert all((r.rule is None) == (r.block_score is not None) and r.verdict in ("allow", "block") for r in got.values())


def test_url_rules_verdicts(spark, tmp_path):
    """Each rule of the contract by its own word, on its host and on subdomains, and the longer one where two fit."""
    want = {
        "http://com/en/": ("com/en/", "block"),
        "http://www.other.com/en/712": ("com/en/", "block"),
        "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://www.example.com/en/712?q": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"),
        "http://a.b.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://www.example.net/de/89#x": ("example.net/de/8", "block"),
        "http://ORG/es/": ("org/es/", "block"),
        "http://example.org/es/7": ("org/es/", "block"),
    }
    spark.createDataFrame([(i, u, "<p>some words</p>") for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.op10_urls(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_urls_against_plain_form(spark, tmp_path):
    long = "incomprehensibilitiesandmore"
    fillers = ["f" + "".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(50_000)]
    html = [" ".join(fillers) + " spam cheap", " ".join(fillers) + f" zzrare zzwordy {long} spam", "<b>spam</b> é日本 cheap", None]
    names = ["https://zzrarezzwordy.com/en/1", f"https://{long}spam.example.com/en/7", "https://cheapspam.net/de/1", "http://zzwordy.xx/zzrare", f"http://spam{long}.xx/{'q' * 300}spam12", None, "none", "http://zzwordy.xx/zzrare", "http://é日本cheap.xx/É", "http://www.example.com/en/7"]
    pages = spark.createDataFrame([(i, u, html[i % 4]) for i, u in enumerate(names)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    counts = {r.word: r.n for r in urls.word_counts(pages).collect()}
    known = {r.page_id: r for r in urls.judged(pages).collect()}
    plain = PlainUrls(counts, [(r.host, r.path, r.rule_verdict) for r in known.values()])
    assert len(counts) > 50_000 and plain.words("zzrarezzwordy", long + "spam") == ["h:zzrare", "h:zzwordy", f"p:{long}", "p:spam"]
    names_of = ["zzrarezzwordy", long + "spam", "q" * 300 + "spam", "é日本"]
    split = {r.piece: tuple(r.words) for r in urls.segmented(spark.createDataFrame([(p,) for p in [*names_of, "3 digits"]], "piece string"), urls.word_counts(pages)).collect()}
    assert split == {p: plain.split(p) for p in names_of} | {"3 digits": ("3 digits",)}
    got = {r.page_id: r for r in urls.op10_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(names) and plain.two
    for i, r in got.items():
        score = plain.score(r.host, r.path)
        assert r.verdict == (known[i].rule_verdict or ("block" if score > 0 else "allow")) and r.rule == known[i].rule
        assert r.block_score is None if known[i].rule_verdict else abs(r.block_score - score) < 2e-6
    assert got[3].block_score != got[5].block_score and got[5].block_score == 0.0
    told = PlainUrls(counts, [(r.host, r.path, r.rule_verdict) for r in known.values()], None)
    for r in urls.judge_urls(pages, prior=None).filter("rule IS NULL").collect():
        assert abs(r.block_score - told.score(r.host, r.path)) < 2e-6
    for r in urls.judge_urls(pages, prior=3.0).filter("rule IS NULL").collect():
        assert abs(r.block_score - 3.0 - plain.score(r.host, r.path)) < 2e-6 and r.verdict == ("block" if r.block_score > 0 else "allow")
    lone = urls.judge_urls(pages.filter("page_id between 3 and 8")).collect()
    assert {(r.verdict, r.block_score) for r in lone} == {("allow", -1.0)}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def plain_score(net, raw):
    """The network's formula by loops over places, cells and chunks."""
    q = quality
    data = raw + b"\0" * (q.WIDTH + 2 * q.CELL * q.STRIDE)
    places = max(1, -(-len(raw) // q.STRIDE))
    cells = []
    for c in range(-(-places // q.CELL)):
        most = np.zeros(q.FILTERS)
        for at in range(c * q.CELL, (c + 1) * q.CELL):
            z = net.p["bias"].astype(np.float64)
            for j, byte in enumerate(data[at * q.STRIDE : at * q.STRIDE + q.WIDTH]):
                if byte:
                    lo = j % q.STRIDE * q.DIM
                    z = z + net.p["embed"][byte].astype(np.float64) @ net.p["conv"][j // q.STRIDE][lo : lo + q.DIM]
            most = np.maximum(most, z)
        cells.append(most)
    chunks = [np.maximum(a, b) for a, b in zip(cells, [*cells[1:], cells[-1]])]
    logit = np.concatenate((np.max(chunks, 0), np.mean(chunks, 0))) @ net.p["out"] + net.p["out_bias"][0]
    return 1 / (1 + np.exp(-logit))


def test_score_against_plain_form(monkeypatch):
    rng = np.random.default_rng(7)
    net = quality.Network()
    net.p = {k: rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in net.p.items()}
    texts = [b"", b"a", "é and more".encode() * 9, bytes(rng.integers(1, 256, 1500, dtype=np.uint8)), b"x\0y" * 100]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = [plain_score(net, t) for t in texts]
    for cells in (1, 3, 256):
        monkeypatch.setattr(quality, "PIECE_CELLS", cells)
        assert net.score(np.frombuffer(b"".join(texts), np.uint8), offsets) == pytest.approx(want, abs=1e-4)


def test_score_of_a_long_text_in_bounded_memory():
    import tracemalloc

    size = 16 << 20
    data = np.random.default_rng(0).integers(32, 120, size, dtype=np.uint8)
    tracemalloc.start()
    quality.Network().score(data, np.array([0, size]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.5 * size
