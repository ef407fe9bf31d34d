import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash

from quern.llm import gif_media, jaccard_join, piece_codec, queries
from quern.llm.common import fold
from quern.llm.components import components
from quern.llm.token_counts import vocabulary


def brute_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()))
    classes = list({s for _, s in sets if s})
    parent = list(range(len(classes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = {}
    for k, s in enumerate(classes):
        shared = Counter(o for g in s for o in by_gram.get(g, ()))
        for o, c in shared.items():
            if 100 * c >= percent * (len(s) + len(classes[o]) - c):
                parent[max(root(k), root(o))] = min(root(k), root(o))
        for g in s:
            by_gram.setdefault(g, []).append(k)
    at = {s: root(k) for k, s in enumerate(classes)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[at[s]] = min(least.get(at[s], i), i)
    return sorted(((i, len(s), least.get(at[s], i) if s else i) for i, s in sets), key=str)


def near_copies(seed, groups=6, size=25):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 40, 120]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randrange(4)):
                text[rnd.randrange(len(text))] = f"new{rnd.randrange(50)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, " ".join(f"common{rnd.randrange(6)}" for _ in range(60))) for i in range(40)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_like_brute_force(spark, documents, odd, n, percent):
    made = spark.createDataFrame(near_copies(n), "doc_id long, text string")
    for docs in (documents, made, odd):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = jaccard_join.components_of(docs, n=n, percent=percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, n, percent)


def test_one_of_each(spark, odd, none):
    made = spark.createDataFrame(near_copies(9), "doc_id long, text string")
    rows = [tuple(r) for r in made.collect()]
    want = sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(made).collect()) == want
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = Counter((r["doc_id"], (r["text"] or "")[:12]) for r in kept.collect())
    assert texts[1, "a b c d e f "] == 1 and (6, "A B C D E F ") not in texts  # a copy but for case
    assert texts[2, ""] == texts[3, ""] == texts[4, " \t\n "] == 1 and texts[None, "null id text"] == 1 and sum(texts.values()) == 9
    assert jaccard_join.one_of_each(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    rnd = random.Random(4)
    rnd.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def test_gif_round_trips():
    rnd = random.Random(2)
    for n in (64, 640, 64 * 1024, 64 * 1025):
        for payload in (bytes(rnd.choices(range(256), k=n)), bytes(rnd.choices(b"ab ", k=n)), bytes(n)):
            w, h, frames = gif_media.read_gif(gif_media.write_gif(payload))
            assert b"".join(f["pixels"] for f in frames) == payload and w == 64 and h == min(n // 64, 1024)
            assert len(frames) == -(-n // 65536) and {f["delay_ms"] for f in frames} == {100}


def pack_codes(codes, least):
    """Codes to bytes one by one, as a check of the vectorised packing."""
    value = shift = 0
    width, known, out = least + 1, (1 << least) + 1, b""
    for c in codes:
        value |= c << shift
        shift += width
        known += 1
        if c == 1 << least:
            width, known = least + 1, (1 << least) + 1
        elif known == 1 << width and width < 12:
            width += 1
    return value.to_bytes(-(-shift // 8), "little")


def test_lzw_streams_of_other_writers():
    # The classic example of the format: clear, 1, 6 (the pair just made), ..., with a small code size.
    assert gif_media.lzw_decode(pack_codes([4, 1, 6, 6, 2, 9, 9, 7, 8, 10, 2, 12, 1, 14, 15, 6, 0, 21, 0, 10, 7, 22, 23, 18, 26, 7, 10, 29, 13, 24, 12, 18, 16, 36, 12, 5], 2), 2, 100)[:12] == bytes([1] * 5 + [2] * 5 + [1, 1])
    with pytest.raises(gif_media.GifError):
        gif_media.lzw_decode(pack_codes([4, 1, 30, 5], 2), 2, 10)
    with pytest.raises(gif_media.GifError):
        gif_media.lzw_decode(b"", 8, 4)


def gif(width, height, palette, frames):
    """A small writer with all options: frames are (left, top, w, h, indexes, disposal, transparent, interlaced)."""
    out = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\x81\0\0" + bytes(sum(palette, []))
    out += b"\x21\xfe\x04note\0"
    for left, top, w, h, indexes, disposal, clear, interlaced in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + b"\x05\0" + bytes([clear or 0]) + b"\0"
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 if interlaced else 0]) + b"\x02"
        codes = pack_codes([c for i in indexes for c in (4, i)] + [5], 2)
        out += bytes([len(codes)]) + codes + b"\0"
    return out + b";"


def test_transparency_disposal_and_interlacing():
    red, green, blue, white = [255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]
    palette = [red, green, blue, white]
    data = gif(2, 2, palette, [(0, 0, 2, 2, [0, 0, 0, 0], 1, None, False), (1, 0, 1, 1, [1], 3, None, False), (0, 0, 2, 1, [2, 3], 2, 3, False), (0, 0, 2, 2, [3, 3, 3, 3], 0, 3, False)])
    _, _, f = gif_media.read_gif(data)
    assert f[0]["pixels"] == bytes(red * 4) and f[0]["mode"] == "RGB" and f[0]["delay_ms"] == 50
    assert f[1]["pixels"] == bytes(green)
    assert f[2]["pixels"] == bytes(blue + red)  # the green pixel was put back, white is transparent
    assert f[3]["pixels"] == bytes([0, 0, 0, 0, 0, 0] + red * 2)  # the third frame's place was cleared
    assert f[0]["red"] == [0] * 7 + [4] and f[0]["blue"] == [4] + [0] * 7
    rows = [[i % 4] for i in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    _, _, f = gif_media.read_gif(gif(1, 9, palette, [(0, 0, 1, 9, [rows[i][0] for i in order], 0, None, True)]))
    assert f[0]["pixels"] == bytes(sum((palette[i % 4] for i in range(9)), []))


def test_histograms_are_of_the_frame_and_alpha_of_what_was_drawn():
    first, second = bytes([200]) * 65_536, bytes([10]) * 64
    _, _, f = gif_media.read_gif(gif_media.write_gif(first + second))
    assert len(f) == 2 and f[0]["red"][6] == 65_536 and f[1]["red"] == [64, 0, 0, 0, 0, 0, 0, 0] and f[1]["alpha"] is None
    palette = [[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]
    _, _, f = gif_media.read_gif(gif(2, 2, palette, [(0, 0, 2, 2, [0, 3, 3, 0], 2, 3, False), (1, 1, 4, 3, [1] * 12, 0, None, False), (5, 5, 1, 1, [1], 0, None, False)]))
    assert f[0]["alpha"] == bytes([255, 0, 0, 255]) and f[0]["pixels"] == bytes([255, 0, 0, 0, 0, 0, 0, 0, 0, 255, 0, 0])
    assert (f[1]["width"], f[1]["height"], f[1]["pixels"], f[1]["alpha"]) == (1, 1, bytes([0, 255, 0]), None)  # clipped
    assert (f[2]["width"], f[2]["height"], f[2]["pixels"]) == (0, 0, b"")


def test_gif_query_features_and_stored_form(spark, tmp_path):
    texts = ["", "a" * 70, "".join(chr(32 + i % 90) for i in range(140_001)), "a" * 70]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op7_gif_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        payload = t.encode() + bytes(-len(t) % 64 or (0 if t else 64))
        media = gif_media.write_gif(payload)
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
        r = rows[i]
        assert r["feature"] == f"frames={-(-len(payload) // 65536)} ms=100 grey=" + ",".join(map(str, grey))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[1]["media_sha256"] == rows[3]["media_sha256"]


def test_gif_tables(spark, odd, none):
    stored = gif_media.store(odd, ["doc_id"])
    rows = gif_media.frames(stored).collect()
    texts = Counter((r["text"] or "").encode() for r in odd.collect())
    assert Counter(b"".join(bytes(f["pixels"]) for f in r["frames"])[: r["n_bytes"]] for r in rows) == texts
    bad = spark.createDataFrame([(b"GIF89a",), (None,), (b"",), (bytes(stored.first()["media"])[:-40],)], "media binary")
    assert all(r["frames"] is None for r in gif_media.frames(bad).collect())
    assert gif_media.frames(gif_media.store(none, ["doc_id"])).count() == 0


def test_gif_query_digests(spark):
    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op7_gif_media(spark, data).collect():
        payload = texts[r["doc_id"]] + bytes(-len(texts[r["doc_id"]]) % 64 or (0 if texts[r["doc_id"]] else 64))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))


@pytest.fixture(scope="module")
def encoder():
    return piece_codec.PieceEncoder(vocabulary("piece_bpe_32k.model"))


def samples(seed=1, n=1500):
    rnd = random.Random(seed)
    parts = ["a", "the", "'s", " ", "  ", "\n", " \n", "é", "漢字", "ß", "1", "23", ".", ",", "²", "\t", "ing", "tion", "\x00", "🙂", "<0x41>", "</s>"]
    return ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(n)] + ["x" * 50 + "ing" * 40, ""]


def test_without_dropout_it_is_the_library(encoder):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = samples()
    got = encoder.encode([t.encode() for t in texts], 0.0, 1)
    assert got == [np.array(i, "<u4").tobytes() for i in library.encode(texts)]


def test_dropout_is_seeded_varied_and_lossless(encoder):
    texts = [*samples(2), "▁a ▁ b▁", " ▁", "▁"]
    raw = [t.encode() for t in texts]
    one, again, other = encoder.encode(raw, 0.1, 5), piece_codec.PieceEncoder(vocabulary("piece_bpe_32k.model")).encode(raw[::-1], 0.1, 5)[::-1], encoder.encode(raw, 0.1, 6)
    assert one == again and one != other
    assert all(encoder.decode(i) == t for i, t in zip(one, raw)) and all(encoder.decode(i) == t for i, t in zip(other, raw))
    assert sum(map(len, one)) > sum(map(len, encoder.encode(raw, 0.0, 5)))
    longest = encoder.encode(raw, 1.0, 5)
    assert all(encoder.decode(i) == t for i, t in zip(longest, raw))


def brute_agenda(model, letters, key, below):
    """The agenda by its definition: look for the best candidate that isn't skipped, join, look again."""
    pieces = list(zip(letters.tolist(), range(len(letters))))
    hashed = lambda *x: fold(*[np.full(1, v, np.uint64) for v in x])[0]
    while True:
        options = []
        for i, ((a, place), (b, _)) in enumerate(zip(pieces, pieces[1:])):
            found = model.merges.get(a << 20 | b)
            if found and hashed(hashed(key, place), a << 20 | b) >= below:
                options.append((found[0], i, found[1]))
        if not options:
            return [p for p, _ in pieces]
        _, i, made = min(options)
        pieces[i : i + 2] = [(made, pieces[i][1])]


def test_lockstep_heap_and_definition_agree(encoder):
    model = encoder.model
    letters, starts, per_text = model.cut([t.encode() for t in samples(3, 400)])
    keys = np.arange(1, len(starts) + 1, dtype=np.uint64)
    assert per_text.sum() == len(starts)
    for rate in (0.0, 0.1, 0.6):
        below = np.uint64(int(rate * 2**64))
        ids, counts = model.pieces(letters, starts, keys, below)
        ends = np.cumsum(counts)
        for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(letters)])):
            own = ids[ends[i] - counts[i] : ends[i]].tolist()
            assert own == model.alone(letters[s:e], int(keys[i]), below).tolist()
            if i % 7 == 0:
                assert own == brute_agenda(model, letters[s:e], keys[i], below)


def test_each_occurrence_drops_on_its_own(encoder):
    words = ["the", "tokenization", "international", "extraordinarily"]
    texts = [f"{i} " + " ".join(words) for i in range(4000)]
    whole = {w: encoder.encode([w.encode()], 0.0, 5)[0] for w in words}
    got = encoder.encode([t.encode() for t in texts], 0.1, 5)
    assert all(encoder.decode(ids) == t.encode() for ids, t in zip(got, texts))
    ways = Counter(ids[-len(whole[words[-1]]) :] for ids in got)
    assert len({ids[8:] for ids in got}) > 2000 and len(ways) > 20
    # The one candidate of a segment of two letters is skipped at the rate itself.
    one = encoder.encode([b"\nis"], 0.0, 5)[0][-4:]
    assert 330 < sum(not ids.endswith(one) for ids in encoder.encode([f"{i}\nis".encode() for i in range(4000)], 0.1, 5)) < 470
    # How texts are batched doesn't change a result.
    texts = [t.encode() for t in samples(4)]
    assert [x for i in range(0, len(texts), 100) for x in encoder.encode(texts[i : i + 100], 0.3, 5)] == encoder.encode(texts, 0.3, 5)


def test_piece_tables(odd, none):
    rows = piece_codec.decode(piece_codec.encode(odd, ["doc_id"])).collect()
    assert Counter(r["decoded"] for r in rows) == Counter(r["text"] or "" for r in odd.collect())
    assert piece_codec.decode(piece_codec.encode(none, ["doc_id"])).count() == 0
