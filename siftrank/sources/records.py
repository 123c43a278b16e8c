"""Records of web archives, as tasks find them in files.

Neither a compressed archive nor the record format allows a reader to start just
anywhere: places to start at are those that :func:`pieces` finds, from a record to
another, in compressed archives where a member begins with a record.
"""

import io
import warnings
import zlib

import siftrank.sources.files as files

# Markers and field names of the archive format.
RECORD_MARK = b"WARC/"
LENGTH_FIELD = "Content-Length"
COLUMN_OF_FIELD = {
    "WARC-Type": "warc_type",
    "WARC-Date": "warc_date",
    "WARC-Record-ID": "warc_record_id",
    "Content-Type": "content_type",
}
CR, LF = 13, 10
# Fixed value: the largest length a header can state; others are not lengths.
LONGEST = 2**31 - 1

READ_BYTES = 4 << 20


def _fields(stream) -> tuple[dict, int] | None:
    """Header fields up to the blank line that follows a valid length.

    Blank lines before that are passed over: some crawls have them within
    their headers.
    """
    fields, length = {}, -1
    for raw in stream:
        line = raw.decode("utf-8", "replace").strip()
        if not line:
            if length >= 0:
                return fields, length
            continue
        name, _, value = (part.strip() for part in line.partition(":"))
        if name == LENGTH_FIELD:
            stated = int(value) if value.isascii() and value.isdigit() and len(value) < 20 else -1
            length = stated if stated <= LONGEST else -1
        else:
            fields[name] = value
    return None


def _payload(stream, length: int) -> bytes | None:
    """``length`` bytes, after the line ends that may still precede them.

    Bytes are looked at in pairs, and a pair that is or holds a line end does
    not count. ``None`` when the file ends first.
    """
    if length == 0:
        return b""
    if length == 1:
        lead = stream.read(1)
        while lead and lead[0] in (CR, LF):
            lead = stream.read(1)
        return lead or None
    lead = stream.read(2)
    while len(lead) == 2 and (lead[0] == CR or lead[1] == LF):
        lead = stream.read(2)
    pieces, missing = [lead], length - len(lead)
    # in pieces: a wrong length must not claim more memory than the file has bytes
    while missing and (piece := stream.read(min(missing, READ_BYTES))):
        pieces.append(piece)
        missing -= len(piece)
    return None if missing else b"".join(pieces)


def _skip(stream, n: int) -> bool:
    """Passes over ``n`` bytes; whether the stream has so many."""
    if stream.seekable():
        return stream.seek(n, io.SEEK_CUR) <= stream.raw.size
    while n and (piece := stream.read(min(n, READ_BYTES))):
        n -= len(piece)
    return not n


def _skipped(stream, length: int) -> bool:
    """As :func:`_payload`, but without the bytes: whether the file has them all."""
    if length < 2:
        return _payload(stream, length) is not None
    lead = stream.read(2)
    while len(lead) == 2 and (lead[0] == CR or lead[1] == LF):
        lead = stream.read(2)
    return len(lead) == 2 and _skip(stream, length - 2)


def records(stream, record_type: str, payload: bool = True):
    """Records of one type, numbered from 1; every type if it is empty.

    A file that is cut off ends with its last whole record. Without ``payload`` the
    content is passed over, where possible without reading it.
    """
    number = 0
    for line in stream:
        if not line.startswith(RECORD_MARK):
            continue
        head = _fields(stream)
        if head is None:
            return
        fields, length = head
        wanted = not record_type or fields.get("WARC-Type") == record_type
        content = None
        if not (wanted and payload):
            if not _skipped(stream, length):
                return
        elif (content := _payload(stream, length)) is None:
            return
        if not wanted:
            continue
        number += 1
        row = {column: fields.pop(name, "") for name, column in COLUMN_OF_FIELD.items()}
        yield row | {
            "record_no": number,
            "content_length": length,
            "headers": list(fields.items()),
            "content": content,
        }


class Stretch(io.RawIOBase):
    """Bytes from ``start`` to ``end`` of a file that can be read from any place."""

    def __init__(self, raw, start: int, end: int):
        self.raw, self.start, self.size, self.at = raw, start, end - start, 0
        raw.seek(start)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), max(0, self.size - self.at))
        if not n:
            return 0
        self.raw.seek(self.start + self.at)
        data = self.raw.read(n)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


class Unzipped(io.RawIOBase):
    """A gzip file of one or more members; what is cut off or broken ends it.

    ``members`` has, by its place in the unpacked stream, where each one after the
    first begins in the file, and ``whole`` tells whether nothing was lost so far.
    """

    def __init__(self, raw):
        self.raw = raw
        self.member = zlib.decompressobj(wbits=31)
        self.taken = self.given = 0
        self.members: dict[int, int] = {}
        self.whole = True

    def readable(self) -> bool:
        return True

    def _read(self) -> bytes:
        piece = self.raw.read(1 << 16) or b""
        self.taken += len(piece)
        return piece

    def readinto(self, buffer) -> int:
        while True:
            if self.member.eof:
                # members may be padded with zeros
                packed = self.member.unused_data.lstrip(b"\0")
                while not packed and (piece := self._read()):
                    packed = piece.lstrip(b"\0")
                if not packed:
                    return 0
                self.members[self.given] = self.taken - len(packed)
                self.member = zlib.decompressobj(wbits=31)
            else:
                packed = self.member.unconsumed_tail or self._read()
                if not packed:
                    return self._lost("a compressed archive is cut off")
            try:
                data = self.member.decompress(packed, len(buffer))
            except zlib.error as broken:
                return self._lost(f"a compressed archive is broken: {broken}")
            if data:
                buffer[: len(data)] = data
                self.given += len(data)
                return len(data)

    def _lost(self, message: str) -> int:
        # an empty file is no archive, but nothing of it is lost
        if self.taken:
            self.whole = False
            warnings.warn(message, stacklevel=3)
        return 0


def open_file(path: str):
    """A file on any file system that can be read from any place."""
    file_system, inner = files.file_system(path)
    return file_system.open_input_file(inner)


def stretch(opened, path: str, start: int, end: int):
    """Buffered stream of a stretch of an opened file, unpacked if it is gzip.

    One that is not packed can be moved about in.
    """
    raw = Stretch(opened, start, end)
    if path.endswith("gz"):
        return io.BufferedReader(Unzipped(raw), 1 << 20)
    return io.BufferedReader(raw, 1 << 16)


def open_stretch(path: str, start: int, end: int):
    """:func:`stretch` of a file that is opened for it alone."""
    return stretch(open_file(path), path, start, end)


class Placed:
    """A stream that knows how many bytes were taken from it."""

    def __init__(self, stream):
        self.stream, self.raw, self.at = stream, stream.raw, 0

    def __iter__(self):
        for line in self.stream:
            self.at += len(line)
            yield line

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.at += len(data)
        return data

    def seekable(self) -> bool:
        return self.stream.seekable()

    def seek(self, offset: int, whence: int) -> int:
        self.at += offset
        return self.stream.seek(offset, whence)


def pieces(path: str, length: int, record_type: str, piece_bytes: int) -> list[dict]:
    """A file in pieces of ``piece_bytes`` or more: ``start``, ``end``, and how many
    records (of one type) come ``before`` and are ``within``.

    ``whole`` is false for the last piece of a file that ends within a record or
    cannot be unpacked to its end.
    """
    packed = path.endswith("gz")
    found, start, before, number, whole = [], 0, 0, 0, True
    with open_stretch(path, 0, length) as opened:
        stream = Placed(opened)
        for line in stream:
            if not line.startswith(RECORD_MARK):
                continue
            at = stream.at - len(line)
            if packed:
                at = stream.raw.members.pop(at, start)
            if at - start >= piece_bytes:
                found.append({"start": start, "end": at, "before": before, "within": number - before})
                start, before = at, number
            head = _fields(stream)
            if head is None or not _skipped(stream, head[1]):
                whole = False
                break
            number += not record_type or head[0].get("WARC-Type") == record_type
        whole = whole and (not packed or stream.raw.whole)
    found.append({"start": start, "end": length, "before": before, "within": number - before})
    return [piece | {"whole": whole or k < len(found) - 1} for k, piece in enumerate(found)]
