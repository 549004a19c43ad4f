"""Tags of made files of each kind, whole and damaged."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from soundlake.sources import files, tags

WANT = ("Träume", "Ärtist 名", "Various", "Album", "Jazz", 1999, 7, True, None)


def seven(n):
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def frame(name, body, version):
    if version == 2:
        return name.encode() + len(body).to_bytes(3, "big") + body
    size = seven(len(body)) if version == 4 else struct.pack(">I", len(body))
    return name.encode() + size + b"\0\0" + body


def id3(version, unsync=False, extended=False, sound=b"\xff\xfb\x90\x00" * 50):
    names = ("TT2", "TP1", "TP2", "TAL", "TYE", "TRK", "TCO", "PIC") if version == 2 else ("TIT2", "TPE1", "TPE2", "TALB", "TDRC" if version == 4 else "TYER", "TRCK", "TCON", "APIC")
    texts = (b"\x01" + WANT[0].encode("utf-16"), (b"\x03" + WANT[1].encode() if version == 4 else b"\x01\xfe\xff" + WANT[1].encode("utf-16-be")), b"\0Various", b"\0Album\0more", b"\x031999-03-01" if version == 4 else b"\x001999", b"\x007/12", b"\0(8)", b"\0image/png\0\x03\0" + b"\x89PNG\xff\x00\xff" * 40)
    own = lambda x: x.replace(b"\xff", b"\xff\x00") if unsync and version == 4 else x
    body = b"".join(frame(n, own(x), version) for n, x in zip(names, texts, strict=True))
    if extended:
        body = (struct.pack(">IHI", 6, 0, 0) if version == 3 else seven(6) + b"\x01\0") + body
    body += b"\0" * 30
    if unsync and version < 4:
        body = body.replace(b"\xff", b"\xff\x00")
    return b"ID3" + bytes([version, 0, (0x80 if unsync else 0) | (0x40 if extended else 0)]) + seven(len(body)) + body + sound


def comments(head=b""):
    pairs = ["title=" + WANT[0], "ARTIST=" + WANT[1], "AlbumArtist=Various", "ALBUM=Album", "DATE=1999-01-01", "TRACKNUMBER=07", "GENRE=Jazz", "x=y", "METADATA_BLOCK_PICTURE=AAAA"]
    return head + struct.pack("<I", 4) + b"prog" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p.encode())) + p.encode() for p in pairs)


def flac():
    body = comments()
    return b"fLaC" + b"\0" + (34).to_bytes(3, "big") + b"\0" * 34 + b"\x84" + len(body).to_bytes(3, "big") + body


def ogg(head):
    first, second = b"\x01vorbis" + b"\0" * 23, comments(head) + b"\x01"
    out = b""
    for packet in (first, second + b"." * 700):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        out += b"OggS" + b"\0" * 22 + bytes([len(sizes)]) + bytes(sizes) + packet
    return out


def atom(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def mp4():
    data = lambda kind, x: atom(b"data", struct.pack(">II", kind, 0) + x)
    items = [(b"\xa9nam", data(1, WANT[0].encode())), (b"\xa9ART", data(1, WANT[1].encode())), (b"aART", data(1, b"Various")), (b"\xa9alb", data(1, b"Album")), (b"\xa9day", data(1, b"1999-01-01")), (b"trkn", data(0, struct.pack(">HHHH", 0, 7, 12, 0))), (b"gnre", data(0, b"\0\x09")), (b"covr", data(13, b"\xff\xd8"))]
    meta = atom(b"meta", b"\0\0\0\0" + atom(b"ilst", b"".join(atom(n, x) for n, x in items)))
    return atom(b"ftyp", b"M4A ") + struct.pack(">I4sQ", 1, b"mdat", 16 + 50) + b"." * 50 + atom(b"moov", atom(b"mvhd", b"\0" * 20) + atom(b"udta", meta))


def wav(tagged=True):
    info = b"INFO" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"INAM", "Träume".encode()), (b"IART", WANT[1].encode()), (b"ICRD", b"1999"), (b"ITRK", b"7"), (b"IGNR", b"Jazz"), (b"IPRD", b"Album\0")))
    inner = b"WAVE" + (b"LIST" + struct.pack("<I", len(info)) + info if tagged else b"") + b"data" + struct.pack("<I", 4) + b"\0" * 4
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def oldest():
    return b"\xff\xfb\x90\0" * 40 + b"TAG" + "Träume".encode("latin-1").ljust(30, b"\0") + b"An Artist".ljust(30) + b"Album".ljust(30, b"\0") + b"1999" + b"remark".ljust(28, b"\0") + b"\0\x07\x08"


KINDS = {f"v2.{v}{'u' if u else ''}{'x' if x else ''}": (lambda v=v, u=u, x=x: id3(v, u, x)) for v in (2, 3, 4) for u in (False, True) for x in ((False, True) if v > 2 else (False,))} | {"flac": flac, "vorbis": lambda: ogg(b"\x03vorbis"), "opus": lambda: ogg(b"OpusTags"), "mp4": mp4}


@pytest.mark.parametrize("kind", list(KINDS))
def test_each_kind(kind):
    assert tags.tags_of(KINDS[kind]()) == WANT


def test_other_kinds():
    assert tags.tags_of(wav()) == ("Träume", WANT[1], None, "Album", "Jazz", 1999, 7, False, None)
    assert tags.tags_of(oldest()) == ("Träume", "An Artist", None, "Album", "Jazz", 1999, 7, False, None)
    assert tags.tags_of(id3(3, sound=b"") + flac()) == WANT
    assert [tags.tags_of(x)[-1] for x in (b"", None, b"no sound", wav(False), b"fLaC\x84\0\0\x09abc")] == ["no_tags", "no_tags", "no_tags", None, "damaged"]
    assert [tags._genre(x) for x in ("17", "(17)Hard Rock", "(17)", "80s", "(loud)", "", "255")] == ["Rock", "Hard Rock", "Rock", "80s", "(loud)", "", ""]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(list(KINDS)), st.integers(0, 2**32))
def test_damage_never_raises(kind, seed):
    rng, data = random.Random(seed), bytearray(KINDS[kind]())
    for _ in range(rng.randint(1, 12)):
        data[rng.randrange(min(len(data), 300))] = rng.randrange(256)
    got = tags.tags_of(bytes(data[: rng.randint(0, len(data))]))
    assert len(got) == 9 and got[-1] in (None, "no_tags", "damaged")


def test_scan(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, data in (("one.mp3", id3(3)), ("two.flac", flac()), ("a b/three.m4a", mp4()), ("a b/bad.ogg", b"OggS" + b"\0" * 22 + b"\xff"), ("big.wav", wav() + b"\0" * 5_000), ("no.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.rel_path: r for r in tags.scan_tagged(spark, str(tmp_path), 4_000).collect()}
    assert set(got) == {"one.mp3", "two.flac", "a b/three.m4a", "a b/bad.ogg", "big.wav"}
    for name in ("one.mp3", "two.flac", "a b/three.m4a"):
        r = got[name]
        assert (r.title, r.artist, r.album_artist, r.album, r.genre, r.year, r.track_no, r.has_cover_art, r.tag_error) == WANT
    assert got["a b/bad.ogg"].tag_error == "damaged" and got["a b/bad.ogg"].title is None
    assert (got["big.wav"].id, got["big.wav"].tag_error, got["big.wav"].size) == (None, "too_large", len(wav()) + 5_000)
    ids = {r.rel_path: r.id for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert all(got[n].id == ids[n] for n in ids if n != "big.wav")
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.txt").write_bytes(b"")
    assert tags.scan_tagged(spark, str(empty)).collect() == []
