"""Operators against plain versions, with nulls, empty and odd texts, repeated rows, empty tables and extra columns."""

import hashlib
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowloom.llm import bpe, jaccard_join, kneser_ney, mpeg_audio, packing, pii, token_counts, toxicity, url_filter
from flowloom.llm.queries import tokenizer

BASE = "the quick brown fox jumps over the lazy dog and runs away from seven angry bears in the dark green forest tonight while it rains"
TEXTS = [None, "", " ", "a  b\n\nc\t d", "x<|endoftext|>y <|endoftext|>", "it's we'll DON'T", "ünï 中文 😀 é", "a" * 500, BASE, BASE, BASE + " again", "mail bob.x@mail.example.com, ip 10.0.0.255 and 999.1.2.3.4, card 4111 1111 1111 11 11, tel +1 (807) 555-5623 4111111111111111 end +49 30 1234567"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string, ids long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_counts_and_bpe(docs, empty):
    path = tokenizer("byte_bpe_50k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [len(x) for x in want]
    ids = bpe.encode(docs, path)
    assert {r.doc_id: r.ids for r in ids.collect()} == dict(enumerate(want))
    assert {r.doc_id: r.text for r in bpe.decode(ids, path).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip_digests(empty, path).count() == 0


def test_packing(docs, empty):
    path = tokenizer("word_bpe_49k.json")
    rows = packing.pack(docs, path, size=16).collect()
    want = [len(e.ids) + 1 for e in Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    sums = dict.fromkeys(range(len(TEXTS)), 0)
    bins: dict = {}
    for r in rows:
        sums[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert list(sums.values()) == want
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16
    assert packing.pack(empty, path).count() == 0


def test_media(docs):
    rows = mpeg_audio.digests(mpeg_audio.store_texts(docs)).collect()
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        raw = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.payload_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    medium = mpeg_audio.store(b"x" * 5000)
    found = mpeg_audio.index(medium[:60] + b"junk\xff\xfb\x90" + medium[60:])
    assert found.skipped > 0 and len(found.offsets) >= 2
    broken = bytearray(medium)
    broken[mpeg_audio.index(medium).offsets[0] + 10] ^= 1
    assert mpeg_audio.index(bytes(broken)).crc_bad == 1


def base_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark):
    texts = [*TEXTS, "a@b.c_x@d.e", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "😀 x@y.zz", "@@a@b", "4" * 9000, "a." * 9000 + "@b" + ".c" * 9000, "+1234567890", "password=b7db7aa4a5fcc78305 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.digests(pii.find(df, pii.fit(df))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id] or "").encode()).hexdigest(), r.doc_id
    clean = {r.doc_id: r.text for r in pii.redacted(df, pii.fit(df)).collect()}
    assert clean[0] is None and clean[1] == "" and "bob" not in clean[11]


def test_jaccard(docs, empty):
    rows = {r.doc_id: r for r in jaccard_join.join(docs).collect()}
    assert rows[8].class_id == rows[9].class_id == rows[10].class_id == 8
    assert (rows[8].n_links, rows[9].n_links, rows[10].n_links, rows[8].n_copies) == (1, 1, 1, 2)
    assert rows[0].class_id == 0 and rows[1].class_id == 1 and rows[2].class_id == 2
    assert jaccard_join.join(empty).count() == 0
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs, jaccard_join.join(docs)).collect()}
    assert kept == set(range(len(TEXTS))) - {9, 10}


def test_language_model(docs, empty):
    model = kneser_ney.fit(docs)
    own = [kneser_ney.tokens(t or "") for t in TEXTS]
    assert model.vocabulary.total == sum(map(len, own))
    assert model.vocabulary.size == len({w for t in own for w in t})
    rows = {r.doc_id: r for r in kneser_ney.score(docs, model).collect()}
    assert all(r.n_tokens == r.n_known == len(own[i]) and r.score < 0 for i, r in rows.items())
    assert kneser_ney.score(docs, kneser_ney.fit(empty)).count() == len(TEXTS)


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = [(i, " ".join([*rng.choice(words, 40), *(["grumblefish", "snarkweed"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(400)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(data, model).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows) >= 390
    assert toxicity.without_toxic(data, model).columns == data.columns
    assert toxicity.score(docs, None).count() == len(TEXTS)


def test_url_rules(spark):
    urls = [None, "no scheme", "https://WWW.Example.org/es/1", "http://a.example.org/en/17", "http://x.org/q?u=1", "ftp://y.com/de/#f", "http://z.com/fr/2", "http://notorg/x", "http://n.net/a/1.html"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [(rows[i].host, rows[i].rule, rows[i].verdict) for i in (2, 3, 4, 5, 6)] == [("www.example.org", "example.org/es/", "block"), ("a.example.org", "example.org/en/1", "block"), ("x.org", "org/", "allow"), ("y.com", "com/de/", "block"), ("z.com", "com/fr/", "allow")]
    assert rows[0].host == rows[1].path == "" and rows[7].rule is None and rows[8].verdict in ("allow", "block")


def test_pii_of_very_long_texts(spark):
    """100,000 addresses in one text: spans and redaction as by plain code, in seconds."""
    import time

    long = " ".join(f"user{k}@mail{k % 7}.example.com, ü" for k in range(100_000))
    rows = [(1, long, "x"), (2, None, "y"), (2, "", "z"), (None, "call 192.168.0.1", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.PiiModel(0.0, (), {"email_like": -1.0, "phone_like": -1.0})
    began = time.time()
    found = {(r.doc_id, r.n_email, r.n_ip): r for r in pii.digests(pii.find(df, model)).collect()}
    want, at = [], 0
    for word in long.split(" "):
        if "@" in word:
            want.append(f"email:{at}:{at + len(word) - 1}")
        at += len(word) + 1
    assert found[1, 100_000, 0].spans == ",".join(want)
    assert (2, 0, 0) in found and found[None, 0, 1].spans == "ip:5:16"
    clean = {(r.doc_id, r.spans): r.text for r in pii.redacted(df, model).collect()}
    assert clean[1, "x"] == re.sub(r"[a-z0-9]+@[a-z0-9.]+", "[email]", long)
    assert clean[2, "y"] is None and clean[2, "z"] == "" and clean[None, "w"] == "call [ip]"
    assert time.time() - began < 90


def test_pii_selects_planted_spans(spark):
    """Spans planted with and without a sign around them; the trees see neither their own labels' rules nor the places."""
    import random

    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choices(letters, k=r.randint(2, 9)))
    key = lambda: "".join(r.choices(letters + letters.upper() + "0123456789" * 3, k=24)) + "aZ7"
    rows, planted = [], {}
    for i in range(1500):
        own = [word() for _ in range(30)]
        if i % 3 == 0:
            planted[i] = key()
            own[10] = f"password={planted[i]}" if i % 2 else f"token: {planted[i]}"
        if i % 3 == 1:
            own[12] = "part/" + "".join(r.choices(letters, k=20)) + str(i)  # a path, no secret
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df, pii.fit(df)).collect()
    hit = {x.doc_id for x in found if x.doc_id in planted and any(s.value == planted[x.doc_id] for s in x.spans)}
    wrong = [x.doc_id for x in found if x.doc_id not in planted and x.spans]
    assert len(hit) >= 0.9 * len(planted) and len(wrong) <= 0.02 * len(rows)
    assert pii.find(df.where("doc_id < 0"), pii.fit(df.where("doc_id < 0"))).count() == 0


def planted_spans(seed, n):
    """Texts with at most one planted value each, and (kind, value) of those that are personal data or secrets."""
    import random

    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    d = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices(letters, k=r.randint(2, 9)))

    def card(valid):
        body = d(15)
        rest = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return body + str((-rest + (0 if valid else r.randint(1, 9))) % 10)

    makers = [
        lambda: ("secret", "".join(r.choices("0123456789abcdef", k=40)), r.choice(["token = ", "password=", "api_key: ", "secret "])),
        lambda: (None, "".join(r.choices("0123456789abcdef", k=40)), r.choice(["commit ", "sha1: ", "build "])),
        lambda: (None, "-".join(word() + "abcd" for _ in range(4)), ""),
        lambda: ("phone_like", f"({d(3)}) {d(3)}-{d(4)}", r.choice(["call ", "phone: ", "", "tel. "])),
        lambda: ("phone_like", f"{d(3)}-{d(3)}-{d(4)}", r.choice(["call ", "phone: ", "contact "])),
        lambda: (None, f"{d(3)}-{d(3)}-{d(4)}", r.choice(["order ", "part ", "invoice: "])),
        lambda: (None, d(10), ""),
        lambda: ("number_like", f"{d(3)}-{d(2)}-{d(4)}", r.choice(["ssn ", "ssn: "])),
        lambda: ("number_like", d(12), r.choice(["account ", "account: ", "konto "])),
        lambda: (None, card(False), ""),
        lambda: (None, d(13), r.choice(["isbn ", "serial ", "tracking: "])),
        lambda: (None, d(11), ""),
        lambda: ("email_like", f"{word()}.{word()} [at] {word()}.{r.choice(['com', 'org', 'net'])}", ""),
        lambda: ("email_like", f"{word()}(at){word()}(dot){r.choice(['de', 'fr', 'edu'])}", r.choice(["mail ", ""])),
        lambda: (None, f"{word()} [at] {word()}.{word()}q", r.choice(["version ", "page ", "build "])),
    ]
    rows, true = [], {}
    for i in range(n):
        kind, value, announced = makers[i % len(makers)]()
        own = [word() for _ in range(30)]
        own[10] = announced + value
        rows.append((i, " ".join(own)))
        if kind:
            true[i] = (kind, value)
    return rows, true


def test_pii_precision_and_recall_by_kind(spark):
    """Trained on one lot of planted texts, judged on another with hard negatives; no kind is left out."""
    model = pii.fit(spark.createDataFrame(planted_spans(1, 3000)[0], "doc_id long, text string").repartition(4))
    assert set(model.thresholds) == set(pii.GENERATORS)
    rows, true = planted_spans(2, 3000)
    found = [(r.doc_id, s.kind, s.value) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), model).collect() for s in r.spans]
    want = {(i, kind, value) for i, (kind, value) in true.items()}
    # a value that two generators propose counts as found by either
    values = {(i, value) for i, _, value in want}
    for kind in pii.GENERATORS:
        own, chosen = [(i, v) for i, k, v in want if k == kind], [(i, v) for i, k, v in found if k == kind]
        recall = sum((i, kind, v) in set(found) for i, v in own) / len(own)
        precision = sum(x in values for x in chosen) / len(chosen)
        print(kind, round(precision, 3), round(recall, 3), len(own), len(chosen))
        assert recall >= 0.9 and precision >= 0.9, (kind, precision, recall)


def frames_of(version, layer, rate_at, mode, bits, n=3, bitrate_at=8):
    """Frames of one kind with the given content bits after the checksum, and a checksum computed bit by bit."""
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, bitrate_at << 4 | rate_at << 2, mode))
    h = mpeg_audio.header(head)
    said = "".join(f"{b:08b}" for b in head[2:4]) + bits
    crc = 0xFFFF
    for bit in said:
        top = crc >> 15 ^ int(bit)
        crc = crc << 1 & 0xFFFF
        if top:
            crc ^= 0x8005
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    return (head + crc.to_bytes(2, "big") + body).ljust(h.size, b"\x55") * n


def test_media_of_other_layers_and_tags(spark):
    tag = b"TAG" + b"a title".ljust(30, b"\0") + b"someone".ljust(30, b"\0") + bytes(65)
    # layer I, joint stereo from subband 8: 8 * 2 + 24 allocations of 4 bits
    one = frames_of(3, 1, 1, 1 << 6 | 1 << 4, "0110" * 40)
    # layer II, MPEG-1, 44.1 kHz, 128 kbit/s stereo (64 a channel: table a); the first band is allocated in one channel
    two = frames_of(3, 2, 0, 0, "0011" + "0000" * 21 + "000" * 24 + "00" * 8 + "10")
    # layer II, MPEG-2, 24 kHz mono: subbands 0 and 1 allocated
    low = frames_of(2, 2, 1, 0xC0, "0001" + "0010" + "0000" * 2 + "000" * 7 + "00" * 19 + "0111")
    # layer III, MPEG-2.5, 8 kHz mono: 9 bytes of side information
    three = frames_of(0, 3, 2, 0xC0, "01" * 36)
    vbri = bytearray(frames_of(3, 3, 0, 0, "0" * 256, n=4)[: 4 * 417])
    vbri[36:54] = b"VBRI" + bytes(6) + (4 * 417).to_bytes(4, "big") + (3).to_bytes(4, "big")
    media = [one, two, low, three, bytes(vbri) + tag, b"junk" * 50 + two + b"more junk", None, b"", b"no audio at all"]
    df = spark.createDataFrame([(i, m, "x") for i, m in enumerate(media)], "doc_id long, media binary, tags string")
    rows = {r.doc_id: r for r in mpeg_audio.index_columns(df).collect()}
    for i, (version, layer, rate, samples) in enumerate([("1", 1, 48000, 384), ("1", 2, 44100, 1152), ("2", 2, 24000, 1152), ("2.5", 3, 8000, 576)]):
        r = rows[i]
        assert (r.version, r.layer, r.sample_rate, r.n_frames, r.crc_ok, r.crc_bad) == (version, layer, rate, 3, 3, 0), r
        assert r.duration_s == 3 * samples / rate and r.seek_offsets == [0, len(media[i]) // 3, 2 * len(media[i]) // 3]
    assert (rows[4].vbr_table, rows[4].vbr_frames, rows[4].n_frames, rows[4].tags) == ("VBRI", 3, 3, {"TIT2": "a title", "TPE1": "someone"})
    assert (rows[5].n_frames, rows[5].skipped_bytes, rows[5].seek_offsets[0]) == (3, 209, 200)
    assert all(rows[i].n_frames == 0 and rows[i].version is None for i in (6, 7, 8))
    foreign = mpeg_audio.digests(df.withColumn("n_bytes", df.doc_id)).collect()
    assert len(foreign) == len(media) and all(r.payload_bytes == 0 for r in foreign) and all(r.feature == "" and r.seek_offsets == [] for r in foreign if r.doc_id > 5)


def id3(major, flags, frames, size=None):
    n = len(frames) if size is None else size
    return b"ID3" + bytes((major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frames


def frame(name, body, flags=b"\0\0"):
    return name + len(body).to_bytes(4, "big") + flags + body


def test_tags_of_all_versions_and_seek_tables(spark):
    audio = frames_of(3, 3, 0, 0, "0" * 256)
    size = len(audio) // 3
    old = b"TT2\0\0\6\0title" + b"TP1\0\0\4\0him"
    extended = (6).to_bytes(4, "big") + bytes(6) + frame(b"TIT2", b"\0title")
    new_extended = b"\0\0\0\6\1\0" + frame(b"TIT2", b"\3title")
    unsync = frame(b"TIT2", b"\1\xff\xfet\0").replace(b"\xff", b"\xff\0")
    unsync = unsync[:4] + (5).to_bytes(4, "big") + unsync[8:]
    new_unsync = frame(b"TIT2", b"\1\xff\0\xfet\0", b"\0\2")
    hidden = frame(b"TIT2", b"\0secret", b"\0\x80") + frame(b"TPE1", b"g\0him", b"\0\x20")
    user = frame(b"TXXX", b"\1" + "key\0".encode("utf-16") + "value".encode("utf-16"))
    items = b"".join(len(v).to_bytes(4, "little") + bytes(4) + k + b"\0" + v for k, v in ((b"Title", b"song"), (b"mood", "é".encode())))
    ape = b"APETAGEX" + b"".join(n.to_bytes(4, "little") for n in (2000, len(items) + 32, 2, 0xA0000000)) + bytes(8) + items + b"APETAGEX" + bytes(24)
    xing = bytearray(frames_of(3, 3, 0, 0, "0" * 256)[:size])
    xing[38:50] = b"Xing" + (7).to_bytes(4, "big") + (3).to_bytes(4, "big")
    xing[50:54], xing[54:154] = (4 * size).to_bytes(4, "big"), bytes(64 * (1 + 3 * k // 100) for k in range(100))
    vbri = bytearray(frames_of(3, 3, 0, 0, "0" * 256)[:size])
    vbri[36:62] = b"VBRI" + bytes(6) + (4 * size).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\3\0\1\0\2\0\1"
    vbri[62:68] = (2 * size).to_bytes(2, "big") + size.to_bytes(2, "big") * 2
    cases = [
        (id3(2, 0, old), {"TIT2": "title", "TPE1": "him"}),
        (id3(3, 0x40, extended), {"TIT2": "title"}),
        (id3(4, 0x40, new_extended), {"TIT2": "title"}),
        (id3(3, 0x80, unsync), {"TIT2": "t"}),
        (id3(4, 0, new_unsync), {"TIT2": "t"}),
        (id3(3, 0, hidden), {"TPE1": "him"}),
        (id3(3, 0, user), {"key": "value"}),
        (id3(3, 0, frame(b"TIT2", b"\0title"), 100_000), {"TIT2": "title"}),
        (id3(3, 0, frame(b"TIT2", b"\0one")) + id3(3, 0, frame(b"TIT2", b"\0two")), {"TIT2": "one"}),
        (b"", {"TIT2": "song", "mood": "é"}),
        (bytes(xing), {}),
        (bytes(vbri), {}),
        (id3(3, 0x40, b"\xff"), {}),
        (b"APETAGEX\0", {}),
    ]
    media = [lead + audio + (ape if i == 9 else b"") for i, (lead, _) in enumerate(cases)]
    rows = {r.doc_id: r for r in mpeg_audio.index_columns(spark.createDataFrame([(i, m) for i, m in enumerate(media)], "doc_id long, media binary")).collect()}
    for i, (lead, tags) in enumerate(cases):
        assert (rows[i].tags, rows[i].n_frames, rows[i].seek_offsets) == (tags, 3, [len(lead) + k * size for k in range(3)]), i
        assert rows[i].skipped_bytes == (len(lead) - 10 if i == 7 else len(lead) if i == 13 else 0), i
    assert rows[10].vbr_table == "Xing" and len(rows[10].seek_table) == 100 and rows[10].seek_table_off < size
    assert rows[11].seek_table == [size, 2 * size, 3 * size] and rows[11].seek_table_off == 0
    assert rows[0].seek_table is None and rows[0].seek_table_off is None


def test_media_payload_with_tags_in_it(spark):
    """Tags in a payload are part of it: they lie within frames, where no tag is looked for."""
    texts = ["ID3" + "\4\0\0\0\0\1\0" * 50, "x" * (mpeg_audio.LARGEST - mpeg_audio.LEAD - 32) + "APETAGEX" + "\0" * 24, "APETAGEX" * 200]
    df = spark.createDataFrame([(None, texts[0]), *enumerate(texts)], "doc_id long, text string")
    for r in mpeg_audio.digests(mpeg_audio.store_texts(df)).collect():
        raw = texts[r.doc_id or 0].encode()
        assert r.payload_sha256 == hashlib.sha256(raw.ljust(max(192, -(-len(raw) // 192) * 192))).hexdigest()


def test_media_payload_that_looks_like_a_tag(spark, empty):
    """TAG may stand anywhere in a payload; all lengths around 128 bytes before the end come back."""
    texts = [" " * k + "TAG" + "x" * (192 * 2 - 3 - k) for k in range(200, 300)]
    rows = mpeg_audio.digests(mpeg_audio.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.duration_s == len(r.seek_offsets) * 1152 / 32000
    assert mpeg_audio.digests(mpeg_audio.store_texts(empty)).count() == 0


def test_long_odd_texts_are_cut_at_safe_places(spark, empty):
    """Texts with odd white space, much longer than a part, count and come back as the library has them."""
    import random

    r = random.Random(5)
    path = tokenizer("byte_bpe_50k.json")
    odd = ["\t", "\r\n", "\n\n", "  ", " ", "\n", "\u00a0", " \u3000", "   x", "it's", "don't ", "<|endoftext|>", "é", "中文", "12 3", "!? ", "word", " the", "\x0b"]
    texts = ["".join(r.choices(odd, k=70_000)), " " * 200_000 + "end", "x" * 5000 + "\t" + "ab cd\n" * 40_000, "\u00a0"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, texts[0], "n"), (None, "a  b", "n")], "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(path)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)} | {None: library.encode("a  b", add_special_tokens=False).ids}
    got = token_counts.token_counts(df, path).collect()
    assert len(got) == len(texts) + 2 and all(x.n_tokens == len(want[x.doc_id]) for x in got)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for x in bpe.round_trip_digests(df, path).collect():
        assert x.ids_sha256 == digest(",".join(map(str, want[x.doc_id])).encode())
        assert x.decoded_sha256 == digest(library.decode(want[x.doc_id], skip_special_tokens=False).encode())
    assert token_counts.token_counts(empty, path).count() == 0


def test_toxicity_query_without_doc_id(spark, tmp_path):
    from flowloom.llm import queries

    rows = [(1, "you are a grumblefish"), (2, "the dog ran home"), (None, "the dog"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op8_toxicity"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.held_out) for r in got if r.doc_id is None) == [(True, False)] * 2
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
