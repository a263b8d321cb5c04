"""Row-local operators: media, tokens, secrets, packing, models."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from glossa.llm import common, logistic, media, ngrams, op01_quality, op04_media, op06_toxicity, op07_pieces, op08_packing, op09_secrets, packing, pieces, quality, secrets

ODD = [None, "", " ", "\n\n", "a", "é" * 70, "x" * 5000, "Hello  world\tnaïve 漢字 \x00 <|endoftext|>", "퟿｡ ́e", "a\r\nb\x0bc"]


def frame(spark, texts, extra=False):
    rows = [(i if i != 3 else None, t, "score") for i, t in enumerate([*texts, *texts[:2]])]
    return spark.createDataFrame(rows, "doc_id long, text string, score string") if extra else spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")


# ------------------------------------------------------------------ op4


def test_payloads_come_back():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 129, 4097):
        data = bytes(rng.choice((0, 255, 127, 128, rng.randrange(256))) for _ in range(n))
        picture = media.decode(media.pack_payload(data))
        length, payload = media.unpack_payload(picture)
        assert (length, payload[:n], len(payload) % 64, set(payload[n:]) <= {0}) == (n, data, 0, True) and len(payload) >= 64
        assert picture.scans == 12 and media.to_rgb(picture).shape == (picture.height, picture.width, 3)


def test_array_and_sequential_scans_agree(monkeypatch):
    data = media.pack_payload(bytes(range(256)) * 3)
    whole = media.decode(data)
    monkeypatch.setattr(media, "_whole_arrays", lambda *a: False)
    step = media.decode(data)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(whole.components, step.components, strict=True))


def hand_made(values, bands):
    """A one-component stream of one block: DC, then AC bands with successive approximation by 1 bit, codes of 8 bits for each symbol."""
    symbols = sorted({0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))})
    dht = lambda k: media._marker(0xC4, bytes([k << 4, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    size = lambda v: abs(v).bit_length()
    bits_of = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    pack = lambda b: media._stuffed(np.packbits(np.array(list(b + "1" * (-len(b) % 8)), np.uint8)))
    out = [b"\xff\xd8", media._marker(0xDB, bytes([0, *[2] * 64])), media._marker(0xC2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])), dht(0), dht(1)]
    out.append(media._sos(1, 0, 0, 0, 0, 1) + pack(code[size(values[0] >> 1)] + bits_of(values[0] >> 1)))
    half = [0, *[int(v / 2) for v in values[1:]]]
    for lo, hi in bands:
        text, run = "", 0
        for k in range(lo, hi + 1):
            if half[k] == 0:
                run += 1
                continue
            while run > 15:
                text, run = text + code[0xF0], run - 16
            text, run = text + code[run << 4 | size(half[k])] + bits_of(half[k]), 0
        out.append(media._sos(1, 0, lo, hi, 0, 1) + pack(text + (code[0] if run else "")))
    out.append(media._sos(1, 0, 0, 0, 1, 0) + pack(str(values[0] & 1)))
    text, pending, run = "", "", 0
    last = max((k for k in range(1, 64) if values[k] in (1, -1)), default=0)
    for k in range(1, 64):
        if half[k]:
            pending += str(abs(values[k]) & 1)
        elif values[k] == 0:
            run += 1
            if run > 15 and k <= last:
                text, pending, run = text + code[0xF0] + pending, "", 0
        else:
            text, pending, run = text + code[run << 4 | 1] + ("1" if values[k] > 0 else "0") + pending, "", 0
    out.append(media._sos(1, 0, 1, 63, 1, 0) + pack(text + code[0] + pending))
    return b"".join([*out, b"\xff\xd9"])


def test_general_progressive_stream():
    rng = random.Random(4)
    for _ in range(20):
        values = [rng.choice((0, 0, 0, 1, -1, 2, -3, 17, -40)) for _ in range(64)]
        picture = media.decode(hand_made(values, [(1, 5), (6, 63)]))
        assert picture.components[0].coefficients[0].tolist() == values
        natural = np.zeros(64)
        natural[media.ZIGZAG] = np.array(values) * 2.0
        k = np.arange(8)
        basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
        want = np.clip(np.rint(basis.T @ natural.reshape(8, 8) @ basis + 128), 0, 255)
        assert np.abs(media.to_rgb(picture)[..., 0] - want).max() <= 1


def test_bad_streams():
    for bad in (b"", b"\xff\xd8\xff", media.pack_payload(b"abc")[:-40], media.pack_payload(b"abc").replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(ValueError):
            media.decode(bad)


def picture_by_definition(padded, height, width):
    """Samples of each block by the cosine sum, chroma repeated both ways, colours by the usual matrix."""
    n = height * width // 256
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    data = padded + bytes(384 * n - len(padded))
    planes = []
    for first, count, down, across in ((0, 4 * n, height // 8, width // 8), (4 * n, n, height // 16, width // 16), (5 * n, n, height // 16, width // 16)):
        plane = np.zeros((8 * down, 8 * across))
        for b in range(count):
            natural = np.zeros(64)
            natural[media.ZIGZAG] = [x if x >= 128 else x - 255 for x in data[64 * (first + b) : 64 * (first + b) + 64]]
            y, x = divmod(b, across)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ natural.reshape(8, 8) @ basis + 128
        planes.append(plane if down == height // 8 else plane.repeat(2, 0).repeat(2, 1))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255).astype(int)


def test_op4_rows(spark):
    rows = op04_media.read_media(op04_media.store_texts(frame(spark, ODD))).collect()
    assert len(rows) == len(ODD) + 2
    for r, text in zip(rows, [*ODD, *ODD[:2]], strict=True):
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        across = int(np.ceil(np.sqrt(-(-len(padded) // 384))))
        stored = media.pack_payload(data)
        assert (r.height % 16, r.width, r.media_bytes, r.media_sha256) == (0, 16 * across, len(stored), hashlib.sha256(stored).hexdigest())
        rgb = picture_by_definition(padded, r.height, r.width)
        seen = np.frombuffer(r.rgb, np.uint8).reshape(rgb.shape)
        assert np.abs(seen.astype(int) - rgb).max() <= 1  # rounding
        sums = [int(seen[..., k].astype(int).sum()) * 1000 // (r.height * r.width) for k in range(3)]
        bins = [int(((seen[..., 1] >= 32 * k) & (seen[..., 1] < 32 * k + 32)).sum()) for k in range(8)]
        assert r.feature == f"{r.width}x{r.height};" + ",".join(map(str, sums)) + ";" + ",".join(map(str, bins))
    assert rows[0].feature == rows[1].feature and op04_media.read_media(op04_media.store_texts(frame(spark, ODD).limit(0))).count() == 0


# ------------------------------------------------------------------ op7, op8


def best_ids(v, text):
    """The whole lattice at once: of equal sums, the way whose last piece is longer."""
    n = len(text)
    best, back = [0.0] + [float("-inf")] * n, [(0, [])] * (n + 1)
    for a in range(n):
        if text[a] not in v.scores and best[a] + v.fallback > best[a + 1]:
            best[a + 1], back[a + 1] = best[a] + v.fallback, (a, v.fall_back(text[a]))
        for b in range(a + 1, min(n, a + v.longest) + 1):
            if text[a:b] in v.scores and best[a] + v.scores[text[a:b]][0] > best[b]:
                best[b], back[b] = best[a] + v.scores[text[a:b]][0], (a, [v.scores[text[a:b]][1]])
    out = []
    while n:
        out, n = back[n][1] + out, back[n][0]
    return out


def test_viterbi_is_best_and_streams():
    coder = pieces.PieceIds(pieces.vocabulary())
    v = coder.v
    rng = random.Random(7)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("then ating  \n漢é", k=80)) for _ in range(20)] + ["".join(rng.choices("thenatig", k=700)) + " a b"]
    for text in texts:
        want = best_ids(v, pieces.spelt(text))
        parts = [text[i : i + 3] for i in range(0, len(text), 3)]
        assert want == coder.encode(text).tolist() == [i for part in pieces.stream(v, iter(parts)) for i in part]
        assert v.decode(want) == text.encode()


def test_scores_of_unigrams_stay_fractions():
    v = pieces.Vocabulary.of_pieces({"a": -1.4, "b": -1.4, "ab": -2.6, "abab": -5.5})
    encoder = pieces.StreamingViterbi(v)
    assert encoder.feed("abab") + encoder.finish() == [258, 258] == best_ids(v, "abab")  # rounded, -6 would lose to -6


def test_window_is_bounded_on_the_query_path(spark, monkeypatch):
    text = "".join(random.Random(8).choices("thenatigrs", k=1_000_000))
    coder = pieces.PieceIds(pieces.vocabulary())
    ids = coder.encode(text)
    assert coder.v.decode(ids.tolist()) == text.encode() and not coder.at
    assert coder.encoder.most <= 2 * coder.v.longest + 2 and coder.encoder.held <= pieces.CHUNK
    monkeypatch.setattr(pieces.StreamingViterbi, "feed", lambda self, part: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pieces.PieceIds(pieces.vocabulary()).encode("some words")


def test_op7_rows(spark):
    rows = op07_pieces.encode_decode(frame(spark, ODD)).collect()
    assert all(r.lossless for r in rows) and rows[1].n_ids == 0 and rows[0].n_ids == 0 and len(rows) == len(ODD) + 2


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op08_packing.vocabulary())
    words = op08_packing.WordIds(op08_packing.vocabulary(), most=10)
    rng = random.Random(8)
    alphabet = "abcXYZ 's've09éßÀ×÷İŉſĳ漢½ﬁ  \n\t.,!<|>_-"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(120)) for _ in range(60)] + ["a<|endoftext|>b <|startoftext|>", "I'LL we've x'S"]
    for text in texts:
        assert words.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_many_texts_are_those_of_each():
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op08_packing.vocabulary())
    words = op08_packing.WordIds(op08_packing.vocabulary(), most=50)
    assert words.quick is not None
    rng = random.Random(9)
    alphabet = "abcdefgXYZ 's've09éßÀ×÷İŉſĳ漢½ﬁ  \n\t.,!<|>_-"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(80)] + ["", "a<|endoftext|>b \n\t", "I'LL we've x'S", ""]
    wanted = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for lo, hi in op08_packing.parts(pa.array(texts), 700):
        ids, ends = words.encode_all(pa.array(texts)[lo:hi])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == wanted[lo:hi]
    # Each different unit is looked at once, however often it stands there.
    seen = []
    words.places = lambda units, places=words.places: seen.append(len(units)) or places(units)
    words.encode_all(pa.array(["one two one"] * 1000 + ["two"]))
    assert seen == [2]


def test_quick_merges_are_the_tokenizers():
    """Every word of the vocabulary, and random ones of its letters."""
    words = op08_packing.WordIds(op08_packing.vocabulary())
    rng = random.Random(10)
    known = sorted({t.removesuffix("</w>") for t in words.tokenizer.get_vocab()})
    letters = [x for x in known if x.isascii() and x.isalpha() and x.islower()]
    made = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(20_000)} | set(letters))
    words.learn(made)
    for word in made:
        i = words.at[word]
        assert words.ids[words.ends[i] : words.ends[i + 1]].tolist() == [t.id for t in words.tokenizer.model.tokenize(word)]


def test_parts_hold_every_text_and_few_bytes():
    import pyarrow as pa

    texts = pa.array(["x" * n for n in (0, 5, 3, 12, 1, 1, 9, 0)] + [None])
    ranges = list(op08_packing.parts(texts[1:], 8))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(8))
    assert all(b == a + 1 or sum(len(t.as_py() or "") for t in texts[1 + a : 1 + b]) <= 8 for a, b in ranges)
    assert list(op08_packing.parts(texts[:0])) == []


def packed_by_definition(lengths, c):
    """Every item looks at every bin."""
    scale = [w / f / f for w, f in zip(c.weights, (c.tokens, c.documents, c.attention), strict=True)]
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s, best = int(lengths[i]), None
        for b, (r, d, a) in enumerate(bins):
            if 0 < r >= s and d >= 1 and a >= s * s:
                need, rest = (s, 1, s * s), (r, d, a)
                terms = [k * x * y for k, x, y in zip(scale, need, rest, strict=True)] if c.rule == "dot" else [k * (y - x) ** 2 for k, x, y in zip(scale, need, rest, strict=True)]
                key = (-sum(terms) if c.rule == "dot" else sum(terms), r, b)
                best = min(best or key, key)
        b = best[2] if best else len(bins)
        if not best:
            bins.append((c.tokens, c.documents, c.attention))
        bins[b] = (bins[b][0] - s, bins[b][1] - 1, bins[b][2] - s * s)
        out[i] = b
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_chooses_among_all_bins(rule):
    rng = np.random.default_rng(5)
    for capacity in (packing.Capacity(rule=rule), packing.Capacity(documents=4, attention=2048 * 900, weights=(1.0, 0.5, 0.5), rule=rule)):
        lengths = np.minimum(int(capacity.attention**0.5), rng.lognormal(5.5, 1.2, 400).astype(int) + 1)
        bins, _ = packing.pack(lengths, capacity)
        assert bins.tolist() == packed_by_definition(lengths.tolist(), capacity)
        if capacity.documents == 4:  # both other limits bind
            used = [lengths[bins == b] for b in range(bins.max() + 1)]
            assert any(len(x) == 4 and x.sum() < 1900 for x in used) and bins.max() + 1 > packing.pack(lengths)[0].max() + 1


def test_equal_rows_are_dealt_over_shards(spark):
    items = spark.range(400).selectExpr("CAST(7 AS LONG) AS doc_id", "0 AS piece", "CAST(0 AS LONG) AS start", "CAST(100 AS LONG) AS length", "CAST(1 AS LONG) AS ids_crc32", "1 AS _shard").repartition(4)
    rows = op08_packing.pack_pieces(items.drop("_shard"), shard_items=40).collect()
    assert len(rows) == 400 and len({r.sequence_id % 10 for r in rows}) == 10


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_limit(rule):
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6, 1.2, 3000).astype(int) + 1)
    for capacity in (packing.Capacity(rule=rule), packing.Capacity(documents=3, attention=2048 * 1200 * 2, rule=rule)):
        lengths_ = np.minimum(lengths, int(capacity.attention**0.5))
        bins, offsets = packing.pack(lengths_, capacity)
        for b in range(bins.max() + 1):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert (offsets[at] == np.cumsum(lengths_[at]) - lengths_[at]).all() and lengths_[at].sum() <= capacity.tokens
            assert len(at) <= capacity.documents and (lengths_[at] ** 2).sum() <= capacity.attention
    bins, _ = packing.pack(lengths)
    assert bins.max() + 1 <= np.ceil(lengths.sum() / 2048) * 1.02 + 1
    assert len(packing.pack(np.zeros(0, int))[0]) == 0
    with pytest.raises(ValueError):
        packing.pack(np.array([2049]))


def test_op8_rows(spark):
    texts = [*ODD, "word " * 5000, "word " * 2047, "word " * 2048]
    items = op08_packing.pieces(frame(spark, texts))
    rows = op08_packing.pack_pieces(items, shard_items=4).collect()
    assert len(rows) == items.count() and {r.piece for r in rows if r.doc_id == len(ODD)} == {0, 1, 2}
    assert sorted((r.start, r.length) for r in rows if r.doc_id == len(ODD)) == [(0, 2048), (2048, 2048), (4096, 905)]
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    empty = next(r for r in rows if r.doc_id == 1)
    assert (empty.length, empty.ids_crc32) == (1, zlib.crc32(bytes(4)))
    assert op08_packing.pack_pieces(items.limit(0)).count() == 0


# ------------------------------------------------------------------ op9

KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def test_secrets_base_and_links():
    text = "Password = 'abcdefgh1' token:short secret=token:abcdefghij api-key=x AKIA" + "A" * 11 + " AKIA" + "B" * 12 + " " + "0a" * 16 + "\n"
    base, every = secrets.scan(text)
    assert [s[2] for s in base] == ["assign", "access", "hex"] and base == every
    assert text[base[0][0] : base[0][1]] == "Password = 'abcdefgh1"
    assert secrets.scan(f"id {KEY} alone")[1] == []  # weak alone
    near = secrets.scan(f"AKIA{'B' * 16}\n{KEY}")[1]
    assert [s[2] for s in near] == ["access", "keyid"]
    assert [s[2] for s in secrets.scan(f"AKIA{'B' * 16}\n\n{KEY}")[1]] == ["access"]  # another scope
    assert [s[2] for s in secrets.scan(f"AKIA{'B' * 16} {'x ' * 150}{KEY}")[1]] == ["access"]  # out of reach
    assert [s[2] for s in secrets.scan(f"https://db.host:80/x\n{KEY} AKIA{'B' * 16}")[1]] == ["endpoint", "keyid", "access"]
    assert [s[2] for s in secrets.scan("see https://example.org/a")[1]] == []
    assert secrets.redact(f"a AKIA{'B' * 16} {KEY}!", secrets.scan(f"a AKIA{'B' * 16} {KEY}!")[1]) == "a [ACCESS] [KEYID]!"
    assert secrets.scan("ſecret: abcdefghij")[1] == []  # letters of the keywords are ASCII


def test_secrets_link_across_the_whole_scope(spark):
    for between, linked in (("x " * 5_000, True), ("x \n" * 5_000, True), ("x " * 400 + "\n\n", False)):
        text = f"AKIA{'B' * 16} {between}{KEY}"
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert ("keyid" in op09_secrets.scan_texts(docs).first()["spans"]) == linked
        assert (KEY not in op09_secrets.redact_texts(docs).first()["text"]) == linked


def test_links_by_every_pair():
    """The interval join against all pairs of parts in one scope."""
    rng = random.Random(11)
    words = [f"AKIA{'B' * 16}", KEY, "https://h.example/a", "token=abcdefghij", "x", "\n", "\n\n", " ", "0af9" * 8]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(12))
        base, every = secrets.scan(text, secrets.WHOLE)
        cuts = [m.start() for m in secrets.BLANK.finditer(text)]
        scope = lambda s: sum(c <= s[0] for c in cuts)
        meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
        access = [s for s in base if s[2] == "access"]
        hosts = [(m.start(), m.end(), "endpoint") for m in secrets.ENDPOINT.finditer(text)]
        tokens = [(m.start(), m.end(), "keyid") for m in secrets.TOKEN.finditer(text) if secrets._mixed(m.group())]
        tokens = [t for t in tokens if not any(meets(t, o) for o in base + hosts)]
        keys = [t for t in tokens if any(scope(t) == scope(o) for o in access + hosts)]
        backed = [s for s in base if s[2] != "hex"] + [k for k in keys if any(scope(k) == scope(a) for a in access)]
        linked = keys + [h for h in hosts if any(scope(h) == scope(o) for o in backed) and not any(meets(h, b) for b in base)]
        assert sorted(every) == sorted(base + linked), text


def test_secret_in_a_long_span_with_many_others_is_not_listed_twice():
    inner = "-".join("AKIA" + "B" * 16 for _ in range(12))
    text = f"token={inner}.{KEY} AKIA{'C' * 16}"
    every = secrets.scan(text)[1]
    first = next(s for s in every if s[2] == "assign")
    assert not [s for s in every if s[2] == "keyid" and s[0] < first[1] and first[0] < s[1]]


def test_base_by_definition():
    import re

    rng = random.Random(9)
    words = ["password", "TOKEN", "secret", "api_key", "=", ":", " ", "'", "abcdefgh", "x", "AKIA", "A1B2C3D4E5F6", "0af9" * 8, "f" * 31, ".", "é"]
    for _ in range(400):
        text = "".join(rng.choice(words) for _ in range(14))
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 8]
        want += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        assert sorted(want) == sorted(secrets.base_spans(text))


def test_op9_rows(spark):
    docs = frame(spark, [*ODD, f"AKIA{'B' * 16}"], extra=True)
    rows = op09_secrets.scan_texts(docs).collect()
    assert sum(r.n_access for r in rows) == 1 and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = op09_secrets.redact_texts(docs)
    assert masked.columns == docs.columns and [r.text for r in masked.collect()][len(ODD)] == "[ACCESS]" and masked.first().text is None


# ------------------------------------------------------------------ op1, op6


def test_compression_covers_the_whole_text():
    rng = random.Random(3)
    start = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1 << 16))
    packed = 90 + 9
    assert quality.features(start + "x" * (1 << 18))[packed] < 0.5 * quality.features(start)[packed]


def labelled(spark, n, bad, good, label):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        y = i % 4 != 0 if label == "quality" else i % 4 == 0
        rows.append((i, bad(rng) if (y == (label == "toxic")) else good(rng)))
        if i % 3 == 0 if label == "quality" else i % 2 == 0 or y:  # quality needs rows without a label, too
            labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int")


def prose(rng):
    return " ".join(rng.choice(("the", "river", "runs", "slowly", "over", "old", "stones", "and", "grass")) + rng.choice(("", "", ",", ".")) for _ in range(60))


def test_quality_learns_from_positives(spark):
    docs, labels = labelled(spark, 900, lambda r: " ".join(r.choice(("BUY", "NOW", "CLICK")) + "!!" for _ in range(60)), prose, "quality")
    model = op01_quality.fit(docs, labels)
    rows = op01_quality.score(docs.withColumn("score", docs.doc_id * 0), model).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in rows) >= 0.97 * len(rows) and 0.3 < model.prior <= 0.99
    odd = op01_quality.score(frame(spark, ODD), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == len(ODD) + 2
    assert op01_quality.fit(docs.limit(0), labels.limit(0)).score(np.zeros((1, quality.SIZE)))[0] == 0.5


def test_risk_against_all_rows_at_once(monkeypatch):
    """Sums by parts give the model that one block gives; the prior is near the share of positives."""
    monkeypatch.setattr(quality, "SIZE", 2)
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (600, 2)), np.vstack([rng.normal(1, 1, (1400, 2)), rng.normal(-1.5, 1, (600, 2))])
    whole = quality.fit(p, lambda f: f(u))
    parts = quality.fit(p, lambda f: sum(f(u[i : i + 170]) for i in range(0, len(u), 170)))
    assert np.allclose(whole.weights, parts.weights) and 0.55 <= whole.prior <= 0.85
    assert (whole.score(p) > 0.5).mean() > 0.9 and (whole.score(u[1400:]) < 0.5).mean() > 0.9
    assert quality.fit(p[:0], lambda f: f(u)).score(u[:1])[0] == 0.5 == quality.fit(p, lambda f: f(u[:0])).score(u[:1])[0]


def test_repeated_rows_are_learnt_from_once(spark):
    docs, labels = labelled(spark, 300, lambda r: prose(r) + " you gloomfart", prose, "toxic")
    hot = docs.where("doc_id = 4")
    for _ in range(6):
        hot = hot.union(hot)
    picked = common.labelled_sample(docs.union(hot), labels.union(labels), "toxic", 3, 1, 50).collect()
    assert len({r.doc_id for r in picked}) == len(picked) and max(r.place for r in picked) < 50
    twice = op06_toxicity.score(docs.union(hot), op06_toxicity.fit(docs.union(hot), labels)).where("doc_id = 4").select("score").distinct()
    assert twice.count() == 1
    model = op01_quality.fit(docs.union(hot), labels.withColumnRenamed("toxic", "quality"))
    assert op01_quality.score(docs.union(hot), model, "mine").columns == ["doc_id", "text", "mine"]


def two_humps(seed=3, n=4_000, share=0.6):
    """Counts by bin of margin: positives, and unlabelled rows of which `share` are positives."""
    rng = np.random.RandomState(seed)
    good, bad = rng.normal(6, 2, 3 * n), rng.normal(-9, 4, n)
    binned = lambda x: np.bincount(np.rint((np.clip(x, -quality.EDGE, quality.EDGE) + quality.EDGE) / quality.BIN).astype(int), minlength=len(quality.BINS)).astype(float)
    return binned(good[: 2 * n]), binned(np.concatenate([good[2 * n : 2 * n + int(n * share)], bad[: int(n * (1 - share))]]))


@pytest.mark.parametrize("share", [0.3, 0.6, 0.87])
def test_calibration_settles(share):
    """A finer search gives the same slope; no slope of a grid has less risk."""
    p, u = two_humps(share=share)
    found = []
    for tolerance in (1e-4, 1e-7):
        model = quality.Model(np.zeros(quality.SIZE), np.ones(quality.SIZE), np.zeros(quality.SIZE), 0.0, share)
        quality._calibrate(model, p, u, tolerance)
        found.append((model.slope, model.offset))
    assert np.allclose(found[0], found[1], atol=2e-3) and found[1][1] == 0
    p, u = p / p.sum(), u / u.sum()
    assert all(quality.risk(share, p, u, *found[1]) <= quality.risk(share, p, u, s, 0.0) + 1e-6 for s in np.linspace(0.05, 2, 60))


def test_risk_is_that_of_its_definition():
    p, u = (x / x.sum() for x in two_humps())
    loss = lambda z: np.logaddexp(0, -z)
    for slope, offset in ((0.3, -1.0), (1.0, 0.5), (0.05, 4.0)):
        z = slope * quality.BINS + offset
        want = 0.6 * p @ loss(z) + max(0.0, u @ loss(-z) - 0.6 * p @ loss(-z))
        assert quality.risk(0.6, p, u, slope, offset) == pytest.approx(want)


@pytest.mark.parametrize("share", [0.4, 0.8])
def test_prior_of_a_mixture(share):
    rng = np.random.RandomState(5)
    row = lambda n, at: np.clip(rng.normal(at, 0.1, (n, quality.SIZE)), 0, 1).astype("<f4").astype(float)
    positive, n = row(800, 0.55), 1_500
    unlabelled = np.concatenate([row(int(n * share), 0.55), row(n - int(n * share), 0.35)])
    assert quality.fit(positive, lambda f: f(unlabelled)).prior == pytest.approx(share, abs=0.08)


def test_toxicity_holds_out(spark):
    docs, labels = labelled(spark, 900, lambda r: prose(r) + " you gloomfart", prose, "toxic")
    model = op06_toxicity.fit(docs, labels)
    rows = op06_toxicity.score(docs, model).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in op06_toxicity.score(frame(spark, ODD, extra=True), model).collect())
    none = op06_toxicity.fit(docs.limit(0), labels.limit(0))
    assert op06_toxicity.score(docs, none).select("score").distinct().count() == 1


def known_of(counts):
    """ngrams.Counts of {word: (n0, n1, n)}."""
    stems = {}
    for w in counts:
        stems.setdefault(w[: ngrams.STEM], []).append(w)
    said = [w for w, c in counts.items() if c[0] + c[1]]
    kept = [s for s, ws in stems.items() if any(w in said for w in ws)]
    s = {"stem": np.array([ngrams.stem_hash(x) for x in kept], np.int64), "n": np.array([sum(counts[w][2] for w in stems[x]) for x in kept]), "kinds": np.array([len(stems[x]) for x in kept])}
    w = {"word": np.array([ngrams.word_hash(x) for x in said], np.int64), "stem": np.array([ngrams.stem_hash(x) for x in said], np.int64), **{k: np.array([counts[x][i] for x in said]) for i, k in enumerate(("n0", "n1", "n"))}}
    return ngrams.counts(s, w, float(len(counts)))


@pytest.mark.parametrize("d", [0.6, 1.0, 2.0])
def test_left_out_is_a_model_without_the_row(d):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(4, 8))) for _ in range(120)})
    rows = [(sorted(rng.sample(words, 25)), i % 2) for i in range(12)]
    counts = lambda own: {w: (*(sum(w in r for r, c in own if c == k) for k in (0, 1)), 20) for w in words}
    known = known_of(counts(rows))
    both = ngrams.sums(known, 0, d), ngrams.sums(known, 1, d)
    for i, (own, label) in enumerate(rows):
        rest = counts(rows[:i] + rows[i + 1 :])
        # What no class holds any more has to stay in the table for the ratios to be the models' own.
        whole = known_of({w: c if c[0] + c[1] else (0, 0, c[2]) for w, c in rest.items()})
        want = ngrams.fit(whole, (d, d))
        got = ngrams.left_out(known, both, known.places(own), label)
        assert np.allclose(got, want.of(own)), i


def test_discounts_from_counts_of_counts():
    assert ngrams.estimated(np.array([1, 1, 1, 2, 5, 0])) == 3 / 5 and ngrams.estimated(np.array([4, 0])) == 0.75


def test_class_models_are_distributions():
    """P_c(stem) * P_c(word | stem) sums to 1 over the corpus, and the ratios are those of these probabilities."""
    rng, d = random.Random(4), 3.0
    words = ["".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(300)]
    words = sorted(set(words))
    counts = {w: (rng.choice((0, 0, 1, 5, 40)), rng.choice((0, 0, 2, 9)), rng.randint(60, 90)) for w in words}
    by_stem = {}
    for w in words:
        by_stem.setdefault(w[: ngrams.STEM], []).append(w)
    prob = []
    for c in (0, 1):
        n = {w: counts[w][c] for w in words}
        ns = {s: sum(n[w] for w in ws) for s, ws in by_stem.items()}
        total = sum(ns.values())
        p = {}
        for s, ws in by_stem.items():
            ps = max(ns[s] - d, 0) / total + sum(min(x, d) for x in ns.values()) / total * len(ws) / len(words)
            for w in ws:
                rest = sum(min(n[x], d) for x in ws) / ns[s] if ns[s] else 1.0
                p[w] = ps * ((max(n[w] - d, 0) / ns[s] if ns[s] else 0.0) + rest * counts[w][2] / sum(counts[x][2] for x in ws))
        assert abs(sum(p.values()) - 1) < 1e-9
        prob.append(p)
    got = ngrams.fit(known_of(counts), (d, d)).of(words)
    assert np.allclose(got, [np.log(prob[1][w] / prob[0][w]) for w in words])
    assert len(ngrams.features(np.zeros(0))) == len(op06_toxicity.NAMES)
    assert logistic.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == pytest.approx(0.5)
