"""New WAV files from old ones, byte for byte where nothing changes; metadata in place or by a rewrite.

Data goes by in blocks, so a file of any length needs the memory of a block. A new file is written to a
temporary name beside it, read back, and only then gets its own name, which must be free; files over
4 GB get 64-bit headers.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np

from reelspark.functions import audio
from reelspark.sources import wav

#: Fillers that may be overwritten; room left behind metadata by a rewrite; size of a bext description.
FILLERS = ("JUNK", "PAD ", "FLLR")
HEADROOM = 4096
DESCRIPTION = 256
#: Of each field its iXML tag and its key in a bext description.
FIELDS = {
    "meta_project": ("PROJECT", "PROJECT"), "scene": ("SCENE", "SCENE"), "take": ("TAKE", "TAKE"), "tape": ("TAPE", "TAPE"),
    "note": ("NOTE", "NOTE"), "circled": ("CIRCLED", "CIRCLED"), "ubits": ("UBITS", "UBITS"),
}
BLOCK_FRAMES = 1 << 16
MOST_RIFF = 0xFFFFFFFF


# --- metadata


def _element(tag: str, *inside: ET.Element, text: str | None = None) -> ET.Element:
    made = ET.Element(tag)
    made.text = text
    made.extend(inside)
    return made


def _put(root: ET.Element, path: str, text: str, keep: bool = False) -> None:
    """Sets the text of the first element at a path such as HISTORY/CURRENT_FILENAME, which is made where it isn't; keep leaves one that is."""
    node = root
    for tag in path.split("/"):
        below = node.find(tag)
        made = below is None
        if made:
            below = _element(tag)
            node.append(below)
        node = below
    if made or not keep:
        node.text = text


def _track_list(tracks: list[str]) -> ET.Element:
    """Tracks in the order of their channels, which are their places in the file too."""
    each = [_element("TRACK", *(_element(tag, text=text) for tag, text in (("CHANNEL_INDEX", str(k)), ("INTERLEAVE_INDEX", str(k)), ("NAME", name)))) for k, name in enumerate(tracks, 1)]
    return _element("TRACK_LIST", _element("TRACK_COUNT", text=str(len(tracks))), *each)


def build_ixml(old: bytes | None, changes: dict[str, object], filename: str | None = None, tracks: list[str] | None = None) -> bytes:
    """An iXML document with the changes; what else the old one holds stays. A new file name is kept beside
    the first one, and given tracks replace the list. An old document that can't be read is never replaced: NotWav."""
    root = _element("BWFXML", _element("IXML_VERSION", text="1.61")) if not (old or b"").strip(b"\0 \r\n\t") else wav.ixml_root(old)
    if root is None:
        raise wav.NotWav("its iXML can't be read, so it isn't changed")
    written = {True: "TRUE", False: "FALSE"}
    edits = [(FIELDS[field][0], written[value] if isinstance(value, bool) else str(value), False) for field, value in changes.items()]
    if filename is not None:
        edits += [("HISTORY/ORIGINAL_FILENAME", filename, True), ("HISTORY/CURRENT_FILENAME", filename, False)]
    for path, text, keep in edits:
        _put(root, path, text, keep)
    if tracks is not None:
        lists = root.findall("TRACK_LIST")
        at = list(root).index(lists[0]) if lists else len(root)
        for listed in lists:
            root.remove(listed)
        root.insert(at, _track_list(tracks))
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="utf-8", short_empty_elements=False) + b"\n"


def build_description(old: bytes, changes: dict[str, object], filename: str | None = None) -> bytes:
    """The description's xKEY=VALUE lines with the changes, in 256 bytes; keys that aren't there are not
    added. If it gets too long the note gives way, and if that isn't enough it is a ValueError."""
    text = old.split(b"\0")[0].decode("latin-1").strip()
    wanted = {FIELDS[f][1]: str(v).upper() if isinstance(v, bool) else str(v) for f, v in changes.items()} | ({} if filename is None else {"FILENAME": filename})
    wanted = {k: " ".join(re.split(r"[\r\n]+", v)) for k, v in wanted.items()}

    def filled(shorter: int) -> bytes:
        def line(m: re.Match) -> str:
            value = wanted.get(m[2])
            if value is None:
                return m[0]
            return f"{m[1]}{m[2]}={value[: max(len(value) - shorter, 0)] if m[2] == 'NOTE' else value}"

        return re.sub(r"(?m)^([a-z])([A-Z0-9]+)=[^\r\n]*", line, text).encode("latin-1", "replace")

    out = filled(0)
    if len(out) > DESCRIPTION:
        out = filled(len(out) - DESCRIPTION)
    if len(out) > DESCRIPTION:
        raise ValueError(f"the description would have {len(out)} bytes")
    return out.ljust(DESCRIPTION, b"\0")


# --- files


def _padded(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def header(chunks: list[tuple[bytes, bytes]], data: int) -> bytes:
    """All that comes before the samples: RIFF, or RF64 where the sizes need 64 bits."""
    inner = b"".join(_padded(n, b) for n, b in chunks)
    total = 4 + len(inner) + 8 + data + data % 2
    if total + 36 <= MOST_RIFF:
        return b"RIFF" + struct.pack("<I", total) + b"WAVE" + inner + b"data" + struct.pack("<I", data)
    sizes = _padded(b"ds64", struct.pack("<QQQI", total + 36, data, 0, 0))
    return b"RF64" + struct.pack("<I", MOST_RIFF) + b"WAVE" + sizes + inner + b"data" + struct.pack("<I", MOST_RIFF)


def fmt(channels: int, rate: int, bits: int, is_float: bool) -> bytes:
    align = channels * bits // 8
    return struct.pack("<HHIIHH", 3 if is_float else 1, channels, rate, rate * align, align, bits)


def other_chunks(path: str, h: dict, leave: tuple[str, ...] = ()) -> list[tuple[str, bytes]]:
    """The file's chunks but samples, format, sizes, fillers and those to leave, in order."""
    out = []
    with open(path, "rb") as f:
        for name, at, size, truncated in h["chunks"]:
            if name not in ("data", "fmt ", "ds64", *FILLERS, *leave) and not truncated:
                f.seek(at)
                out.append((name, f.read(size)))
    return out


def whole(path: str) -> dict:
    """The header of a file that can be read to its end."""
    h = wav.read_header(path)
    if h["error"] or h["truncated"]:
        raise wav.NotWav(h["error"] or "truncated")
    return h


def raw_blocks(path: str, h: dict, frames: int = BLOCK_FRAMES) -> Iterator[np.ndarray]:
    """The samples' bytes as (frames, channels, bytes of a sample)."""
    data = next(c for c in h["chunks"] if c[0] == "data")
    width = h["bits"] // 8
    with open(path, "rb") as f:
        f.seek(data[1])
        left = h["frames"]
        while left:
            n = min(frames, left)
            yield np.frombuffer(f.read(n * h["channels"] * width), np.uint8).reshape(n, h["channels"], width)
            left -= n


def _settle(temp: str, out: str) -> str:
    """The temporary file gets its name, unless that is taken by now."""
    try:
        os.link(temp, out)
    except FileExistsError:
        return "exists"
    finally:
        os.remove(temp)
    return "done"


def write_files(outs: list[str], heads: list[bytes], blocks: Iterator[list[np.ndarray]]) -> list[str]:
    """Writes several new files in one pass: of each block the bytes for every file. A file that is there stays."""
    state = ["exists" if os.path.lexists(o) else "" for o in outs]
    temps = [f"{o}.{uuid.uuid4().hex}.part" for o in outs]
    open_: dict[int, object] = {}
    written = [0] * len(outs)
    try:
        for k, s in enumerate(state):
            if not s:
                os.makedirs(os.path.dirname(outs[k]) or ".", exist_ok=True)
                open_[k] = open(temps[k], "wb")
                open_[k].write(heads[k])
        for parts in blocks:
            for k, f in open_.items():
                raw = np.ascontiguousarray(parts[k]).tobytes()
                f.write(raw)
                written[k] += len(raw)
        for k, f in open_.items():
            f.write(b"\0" * (written[k] % 2))
            f.flush()
            os.fsync(f.fileno())
            f.close()
            back = wav.read_header(temps[k])
            if back["error"] or back["truncated"] or os.path.getsize(temps[k]) != len(heads[k]) + written[k] + written[k] % 2:
                raise OSError(f"{outs[k]} did not read back")
        for k in list(open_):
            state[k] = _settle(temps[k], outs[k])
            del open_[k]
    finally:
        for k, f in open_.items():
            f.close()
            if os.path.exists(temps[k]):
                os.remove(temps[k])
    return state


def split_file(path: str, tracks: list[tuple[int, str]]) -> list[str]:
    """One file for each (track from 1, out) in one reading; each keeps the other chunks and its own track's name."""
    h = whole(path)
    if any(not 1 <= t <= h["channels"] for t, _ in tracks):
        raise wav.NotWav("there is no such track")
    kept = other_chunks(path, h)
    names = [h["tracks"][t - 1] if t <= len(h["tracks"]) else "" for t, _ in tracks]
    size = h["frames"] * h["bits"] // 8
    heads = []
    for (_, out), name in zip(tracks, names):
        chunks = [(n.encode(), build_ixml(b, {}, os.path.basename(out), [name]) if n == "iXML" else b) for n, b in kept]
        heads.append(header([*chunks, (b"fmt ", fmt(1, h["sample_rate"], h["bits"], h["float_samples"]))], size))
    return write_files([o for _, o in tracks], heads, ([b[:, t - 1] for t, _ in tracks] for b in raw_blocks(path, h)))


def combine_files(paths: list[str], out: str) -> str:
    """One file of the aligned files' tracks, in order; the first one's chunks stay."""
    hs = [whole(p) for p in paths]
    if len({(h["frames"], h["sample_rate"], h["bits"], h["float_samples"]) for h in hs}) > 1:
        raise wav.NotWav("the files differ")
    h, channels = hs[0], sum(x["channels"] for x in hs)
    names = [n for x in hs for n in [*x["tracks"], *[""] * x["channels"]][: x["channels"]]]
    chunks = [(n.encode(), build_ixml(b, {}, os.path.basename(out), names) if n == "iXML" else b) for n, b in other_chunks(paths[0], h)]
    head = header([*chunks, (b"fmt ", fmt(channels, h["sample_rate"], h["bits"], h["float_samples"]))], h["frames"] * channels * h["bits"] // 8)
    return write_files([out], [head], ([np.concatenate(parts, axis=1)] for parts in zip(*(raw_blocks(p, x) for p, x in zip(paths, hs)))))[0]


def processed_copy(path: str, out: str, touched: dict[int, Callable[[np.ndarray], np.ndarray]], note: str | None = None) -> str:
    """A copy in which each touched track (from 0) went through its kernel; all other bytes are the same.

    A touched track is held whole, as its kernel carries state through it; the others go by in blocks."""
    h = whole(path)
    width, is_float = h["bits"] // 8, h["float_samples"]
    made: dict[int, np.ndarray] = {}
    for c, kernel in touched.items():
        x = np.concatenate([audio.decode_pcm(b[:, c].tobytes(), h["bits"], 1, is_float)[:, 0] for b in raw_blocks(path, h)] or [np.zeros(0, np.float32)])
        y = np.asarray(kernel(x), np.float32)
        if y.shape != x.shape:
            raise wav.NotWav("a kernel changed the length")
        made[c] = np.frombuffer(audio.encode_pcm(y[:, None], h["bits"], is_float), np.uint8).reshape(-1, width)

    def blocks() -> Iterator[list[np.ndarray]]:
        at = 0
        for b in raw_blocks(path, h):
            b = b.copy()
            for c, raw in made.items():
                b[:, c] = raw[at : at + len(b)]
            at += len(b)
            yield [b]

    chunks = [(n.encode(), build_ixml(b, {} if note is None else {"note": note}, os.path.basename(out)) if n == "iXML" else b) for n, b in other_chunks(path, h)]
    with open(path, "rb") as f:
        _, at, size, _ = next(c for c in h["chunks"] if c[0] == "fmt ")
        f.seek(at)
        chunks.append((b"fmt ", f.read(size)))
    return write_files([out], [header(chunks, h["frames"] * h["channels"] * width)], blocks())[0]


def _room(chunks: list[tuple[str, int, int, bool]], k: int) -> tuple[int, int]:
    """Bytes of the k-th chunk with its pad, and those of a filler right behind it (0: there is none)."""
    _, at, size, _ = chunks[k]
    own = size + size % 2
    name, body, spare, _ = chunks[k + 1] if k + 1 < len(chunks) else ("", -1, 0, False)
    return own, 8 + spare if name in FILLERS and body == at + own + 8 else 0


def _fitted(document: bytes, chunks: list[tuple[str, int, int, bool]], k: int) -> bytes | None:
    """What to write from the k-th chunk's head on, so that nothing behind it moves; None if there is no room."""
    own, spare = _room(chunks, k)
    if len(document) <= chunks[k][2]:  # the chunk keeps its size, with zeros behind the document
        return b"iXML" + struct.pack("<I", chunks[k][2]) + document.ljust(chunks[k][2], b"\0")
    grown = _padded(b"iXML", document)
    left = 8 + own + spare - len(grown)  # for a filler of its own head at least
    return grown + chunks[k + 1][0].encode() + struct.pack("<I", left - 8) if spare and left >= 8 else None


def update_metadata(path: str, changes: dict[str, object], filename: str | None = None, allow_rewrite: bool = False) -> str:
    """Puts changed fields into a file: unchanged, in place (the document fits its chunk and a filler right
    behind it), or by a rewrite with room to spare if that is allowed. The fields are read back. A file
    whose document can't be read is left as it is (NotWav)."""
    h = whole(path)
    if filename is None and all(h[field] == value for field, value in changes.items()):
        return "unchanged"
    chunks = h["chunks"]
    place = {name: next((k for k, c in enumerate(chunks) if c[0] == name), None) for name in ("iXML", "bext")}
    body: dict[str, bytes] = {}
    with open(path, "rb") as f:
        for name, k in place.items():
            if k is not None:
                f.seek(chunks[k][1])
                body[name] = f.read(chunks[k][2])
    document = build_ixml(body.get("iXML"), changes, filename)
    bext = build_description(body["bext"][:DESCRIPTION], changes, filename) + body["bext"][DESCRIPTION:] if "bext" in body else None
    fitted = None if place["iXML"] is None else _fitted(document, chunks, place["iXML"])
    if fitted is None and not allow_rewrite:
        return "needs a rewrite"
    if fitted is None:
        _rewritten(path, h, document, bext)
    else:
        with open(path, "r+b") as f:
            f.seek(chunks[place["iXML"]][1] - 8)
            f.write(fitted)
            if bext is not None:
                f.seek(chunks[place["bext"]][1])
                f.write(bext)
            f.flush()
            os.fsync(f.fileno())
    back = wav.read_header(path)
    lost = [field for field, value in changes.items() if back[field] != (value if isinstance(value, bool) else str(value).strip())]
    if back["error"] or lost or back["frames"] != h["frames"]:
        raise OSError(f"did not read back: {', '.join(lost) or back['error'] or 'frames'}")
    return "rewrite" if fitted is None else "in place"


def _rewritten(path: str, h: dict, document: bytes, bext: bytes | None) -> None:
    """The same file with room for the document, through a temporary one that replaces it once it is whole.

    All other bytes stay as they are and in their order, those that no chunk holds and those behind the last one too."""
    size = os.path.getsize(path)
    fresh = _padded(b"iXML", document) + _padded(b"JUNK", bytes(HEADROOM))
    puts: list[tuple[int, int, bytes]] = []  # from, to, what instead
    for name, at, n, _ in h["chunks"]:
        if name == "iXML" and fresh:
            puts.append((at - 8, min(at + n + n % 2, size), fresh))
            fresh = b""
        elif name == "bext" and bext is not None:
            puts.append((at, at + n, bext))
            bext = None
    if fresh:
        head = next(at for name, at, _, _ in h["chunks"] if name == "data") - 8
        puts.append((head, head, fresh))
    more = sum(len(new) - (high - low) for low, high, new in puts)
    with open(path, "rb") as f:
        long_ = next((at for name, at, _, _ in h["chunks"] if name == "ds64"), None)
        at, form = (4, "<I") if long_ is None else (long_, "<Q")
        f.seek(at)
        total = struct.unpack(form, f.read(struct.calcsize(form)))[0] + more
        if long_ is None and total > MOST_RIFF:
            raise ValueError("the file would be too long for its kind")
        puts.append((at, at + struct.calcsize(form), struct.pack(form, total)))
        temp = f"{path}.{uuid.uuid4().hex}"
        times = os.stat(path)
        try:
            with open(temp, "xb") as out:
                now = 0
                for low, high, new in sorted(puts):
                    _copied(f, out, now, low)
                    out.write(new)
                    now = high
                _copied(f, out, now, size)
                out.flush()
                os.fsync(out.fileno())
            if os.path.getsize(temp) != size + more or wav.read_header(temp)["error"]:
                raise OSError("could not be rewritten")
            os.utime(temp, ns=(times.st_atime_ns, times.st_mtime_ns))
            os.replace(temp, path)
        finally:
            if os.path.exists(temp):
                os.remove(temp)


def _copied(f, out, low: int, high: int, block: int = 1 << 22) -> None:
    f.seek(low)
    while low < high:
        part = f.read(min(block, high - low))
        if not part:
            raise OSError("the file got shorter")
        out.write(part)
        low += len(part)
