"""Chats, pictures and web archives."""

import gzip
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from segloom.llm import chat, media, warc

CHAT = "conv_id long, turn long, role string, text string, turns int, merged string"


def plain_chat(rows):
    out = {}
    for conv, turn, role, text in rows:
        role = re.sub(r"[<|>\r\n]", "_", (role or "").strip(" ").lower()) or "unknown"
        out.setdefault(conv, []).append((turn is not None, turn or 0, role, (text or "").replace("<|", "< |")))
    made = {}
    for conv, turns in out.items():
        turns.sort()
        runs = [(r, [t[3] for t in g]) for r, g in groupby(turns, key=lambda t: t[2])]
        text = "".join(f"<|{r}|>\n" + "\n".join(parts) + "<|end|>\n" for r, parts in runs)
        made[conv] = (len(turns), len(runs), len(text), text)
    return made


def test_chats_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, 4, None]), r.choice(["user", " User", "assistant", "", None, "user|>\nhi<|end|>\n<|assistant"]), r.choice(["hi", "", None, "<|user|>\nfake", "yes"])) for _ in range(80)]
    rows += rows[:10] + [(9, k, "user" if k % 3 else "assistant", "x" * 5000) for k in range(300)]
    df = spark.createDataFrame([(*x, 1, "m") for x in rows], CHAT)
    got = {x[0]: tuple(x[1:]) for x in chat.format_chats(df).collect()}
    assert got == plain_chat(rows)
    assert all(x[3].count("<|") == 2 * x[1] and x[3].count("<|end|>\n") == x[1] for x in got.values())
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


# pictures


def idct_luminance(data: bytes) -> np.ndarray:
    """All pixels of the first component by a plain decoder of our own encoder's files."""
    quant, tables, frame = {}, {}, None
    for marker, body, after in media.segments(data):
        if marker == 0xDB:
            quant[body[0]] = list(body[1:65])
        elif marker == 0xC4:
            n = sum(body[1:17])
            codes, code, at = {}, 0, 0
            for size, count in enumerate(body[1:17], 1):
                for s in body[17 + at : 17 + at + count]:
                    codes[f"{code:0{size}b}"] = s
                    code += 1
                at += count
                code <<= 1
            tables[body[0]] = codes
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[k + 1] >> 4, body[k + 1] & 15) for k in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xDA:
            scan = data[after:]
    h, v = frame[0] if len(frame) > 1 else (1, 1)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    image = np.zeros((down * v * 8, across * h * 8))
    unit = 0
    for part in media._split_scan(scan):
        bits, at, last = "".join(f"{b:08b}" for b in part), 0, [0] * len(frame)

        def symbol(codes):
            nonlocal at
            n = 1
            while bits[at : at + n] not in codes:
                n += 1
            at += n
            return codes[bits[at - n : at]]

        def value(n):
            nonlocal at
            at += n
            x = int(bits[at - n : at], 2) if n else 0
            return x if not n or bits[at - n] == "1" else x - (1 << n) + 1

        while unit < across * down and len(bits) - at >= 8:
            for c, (ch, cv) in enumerate(frame if len(frame) > 1 else [(1, 1)]):
                for b in range(ch * cv):
                    block = np.zeros(64)
                    last[c] += value(symbol(tables[0]))
                    block[0], k = last[c], 1
                    while k < 64:
                        s = symbol(tables[16])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[media.ZIGZAG[k]] = value(s & 15)
                        k += 1
                    if c == 0:
                        y, x = (unit // across) * v + b // h, (unit % across) * h + b % h
                        image[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = media._COS.T @ (block.reshape(8, 8) * quant[0][0]) @ media._COS + 128
            unit += 1
    return image


@pytest.mark.parametrize("label", range(12))
def test_thumbnails_are_block_means(label):
    r = np.random.default_rng(label)
    data = media.render(r.normal(0, 0.2, 64), label)
    width, height, components, thumb = media.thumbnail(data)
    full = idct_luminance(data)
    means = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).mean((1, 3))[: thumb.shape[0], : thumb.shape[1]]
    assert np.abs(means - thumb).max() <= 1
    assert (height, width) == (64 - label % 5, 64 - label % 3) and components == (1 if label % 3 == 0 else 3)
    assert thumb.shape == (-(-height // 8), -(-width // 8))


def test_noisy_pictures_of_all_shapes():
    r = np.random.default_rng(7)
    for h, w, sampling, every in [(1, 1, (1, 1), 0), (17, 40, (2, 1), 3), (33, 9, (1, 2), 1), (70, 70, (2, 2), 5), (8, 8, (2, 2), 0)]:
        planes = [r.integers(0, 256, (h, w)) for _ in range(3)]
        data = media.encode(planes, w, h, sampling, step=4, every=every)
        full = idct_luminance(data)
        thumb = media.thumbnail(data)[3]
        means = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).mean((1, 3))[: thumb.shape[0], : thumb.shape[1]]
        assert np.abs(np.clip(means, 0, 255) - thumb).max() <= 1


def test_hashes_of_near_pictures_are_near():
    r = np.random.default_rng(3)
    v = r.normal(0, 0.2, 64)
    near = media.difference_hash(media.thumbnail(media.render(v, 0))[3]) ^ media.difference_hash(media.thumbnail(media.render(v + 0.002, 0))[3])
    far = media.difference_hash(media.thumbnail(media.render(v, 0))[3]) ^ media.difference_hash(media.thumbnail(media.render(r.normal(0, 0.2, 64), 0))[3])
    assert (near & (2**64 - 1)).bit_count() < 6 < (far & (2**64 - 1)).bit_count()


def test_damaged_pictures_are_told(spark):
    good = media.render(np.arange(64) / 100, 1)
    cases = [None, b"", b"GIF89a", good[:200], good[:-30], good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xc4", b"\xff\xee"), b"\xff\xd8\xff\xd9", good, good]
    r = random.Random(1)
    for _ in range(60):
        b = bytearray(good)
        b[r.randrange(len(b))] = r.randrange(256)
        cases.append(bytes(b))
    df = spark.createDataFrame([(k if k % 7 else None, c, "x") for k, c in enumerate(cases)], "vec_id long, jpeg binary, status string")
    out = media.media_columns(df, "vec_id").collect()
    assert len(out) == len(cases)
    count = Counter(x.status for x in out)
    assert count["null"] == 1 and count["not a JPEG"] >= 2 and count["ok"] >= 2 and count["not baseline"] >= 1
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert media.media_columns(media.with_pictures(empty), "vec_id").count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, [], None), (3, [1.0, None], 2)], empty.schema)
    assert [x.status for x in media.media_columns(media.with_pictures(odd), "vec_id").orderBy("vec_id").collect()] == ["null", "ok", "ok"]


# archives

PAGE = "page_id long, url string, html string, length long, offset int, digest string"


def pages(spark, n=300):
    rows = [(k, f"http://x/{k}", "<p>" + "ä" * (k * 7 % 500)) for k in range(n)] + [(None, None, None), (5, "http://x/5", "<p>"), (5, "http://x/5", "<p>"), (6, "", "")]
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], PAGE), rows


def test_audit_finds_all_damage_and_nothing_else(spark):
    df, _ = pages(spark)
    ours = warc.manifest(df, pages_per_file=100)
    listed = [tuple(r) for r in ours.collect()]
    assert warc.audit(ours, ours, 512, 4).count() == 0
    r = random.Random(2)
    theirs, want = [], set()
    for file, offset, length, page, digest in listed:
        luck = r.random()
        if luck < 0.05:
            want.add((file, offset, page, length, "missing", digest, None))
            continue
        if luck < 0.1:
            want.add((file, offset, page, length, "changed", digest, "bad"))
            digest = "bad"
        theirs.append((file, offset, length, page, digest))
    theirs.append((0, 10**7, 3, 77, "new"))
    want.add((0, 10**7, 77, 3, "extra", None, "new"))
    theirs.append((50, 0, 3, 78, "new"))
    want.add((50, 0, 78, 3, "extra", None, "new"))
    other = spark.createDataFrame([*theirs, (None, 1, 1, 1, "x"), (1, None, 1, 1, "x")], "file_id long, offset long, length long, page_id long, digest string")
    assert {tuple(x) for x in warc.audit(ours, other, 512, 4).collect()} == want
    assert {tuple(x) for x in warc.audit(ours, other).collect()} == want


def test_drill_and_empty_tables(spark):
    df, rows = pages(spark)
    import hashlib

    mark = lambda k: hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:2]
    want = Counter((k, {"00": "changed", "01": "missing"}[mark(k)]) for k, *_ in rows if mark(k) in ("00", "01"))
    assert Counter((x.page_id, x.kind) for x in warc.audit(*warc.drill(df, 100)).collect()) == want
    none = spark.createDataFrame([], PAGE)
    assert warc.audit(*warc.drill(none)).count() == 0


def test_records_round_trip(spark, tmp_path):
    df, rows = pages(spark, 40)
    found = warc.records(df, 100).where("file_id = 0").orderBy("offset").collect()
    data = "".join(r.record for r in found).encode()
    parsed = list(warc.parse(data))
    assert [(a, n) for a, n, _, _ in parsed] == [(r.offset, r.length) for r in found]
    assert Counter(b.decode() for *_, b in parsed) == Counter(h or "" for k, _, h in rows if k is not None)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r.record.encode()) for r in found))
    (tmp_path / "c.warc").write_bytes(data[:-5])
    out = warc.read_warc(spark, str(tmp_path)).groupBy("file").count().collect()
    assert {r["file"].rsplit("/", 1)[1]: r["count"] for r in out} == {"a.warc": len(found), "b.warc.gz": len(found), "c.warc": len(found) - 1}


def test_no_header_byte_crashes():
    """Every byte before the scan's data with many values: described or told to be damaged."""
    good = media.encode([np.arange(64).reshape(8, 8) * 3] * 3, 8, 8, (1, 1), every=1)
    head = good.index(b"\xff\xda") + 14
    table = range(good.index(b"\xff\xc4"), good.rindex(b"\xff\xc4") + 200)
    seen = Counter()
    for at in range(head):
        for value in range(256) if at not in table else (0, 1, 16, 127, 128, 255):
            seen[media.describe(good[:at] + bytes([value]) + good[at + 1 :])["status"]] += 1
    assert seen["ok"] > 100 and seen["bad frame"] >= 1 and sum(seen.values()) > 10_000
    frame = good.index(b"\xff\xc0")
    assert media.describe(good[: frame + 9] + b"\0" + good[frame + 10 :])["status"] == "bad frame"
    assert media.describe(media.encode([np.full((8, 8), 64)], 8, 8))["mean"] == 64


def test_hashes_of_thumbnails_by_hand():
    import hashlib

    light = np.tile([10, 200], (8, 9))[:, :9]
    image = np.kron(light, np.ones((8, 8)))
    got = media.describe(media.encode([image], 72, 64, step=1))
    bits = "".join("1" if a > b else "0" for row in light for a, b in zip(row, row[1:]))
    assert got["thumb_hash"] % 2**64 == int(bits, 2) and got["mean"] == pytest.approx(light.mean(), abs=0.5)
    thumb = media.thumbnail(media.encode([image], 72, 64, step=1))[3]
    assert np.abs(thumb.astype(int) - light).max() <= 1
    assert got["thumb_digest"] == hashlib.sha256((9).to_bytes(4, "big") + bytes(int(v) for row in thumb for v in row)).hexdigest()[:32]
