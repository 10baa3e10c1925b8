"""Text of files by their kind.  ``extract`` gives (text, status): ok, empty, ``unsupported: ...`` or ``error: ...``.

Files come as bytes or as open files that can seek.  Archives are read member by member from the open file, compressed
streams go through a file on disk once they are long, so memory holds one member and the text, which has a bound.
"""

from __future__ import annotations

import bz2
import email
import email.policy
import io
import os
import re
import shutil
import subprocess
import tarfile
import tempfile
import time
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

# Suffixes by how their files are read, and the limits for archives.
TEXT = frozenset([".txt", ".md", ".json", ".jsonl", ".py"])
MARKUP = frozenset([".htm", ".html", ".shtml", ".xhtml", ".xht", ".xml"])
MHTML = frozenset([".mht", ".mhtml"])
CONVERTED = frozenset([".mobi", ".azw3", ".azw", ".prc", ".lit", ".pdb", ".chm", ".rtf"])
ARCHIVES = frozenset([".zip", ".bz2", ".7z"])
NOISE = frozenset([
    ".aac", ".apnx", ".avi", ".bmp", ".class", ".css", ".dat", ".db", ".dll", ".ds_store", ".exe", ".flac", ".gif",
    ".ico", ".idx", ".jpeg", ".jpg", ".jpg-old", ".js", ".lnk", ".m4a", ".map", ".mkv", ".mov", ".mp3", ".mp4", ".ogg",
    ".opf", ".png", ".pyc", ".ram", ".svg", ".tif", ".tiff", ".ttf", ".wav", ".webp", ".wma", ".wmv", ".woff",
    ".woff2",
])
MOST_MEMBERS, MOST_BYTES, MOST_SECONDS = 5000, 2 << 30, 300.0
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))

#: Bytes of one text; a row of a table can hold no more than a few times that.
MOST_TEXT = 1 << 29
#: Bytes of unpacked data that are held in memory; more goes to a file.
IN_MEMORY = 32 << 20


class Unsupported(Exception):
    """A kind of file that nothing here reads."""


def plain(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def whole(file: BinaryIO) -> bytes:
    """What is left of a file that is to be one text."""
    data = file.read(MOST_TEXT + 1)
    if len(data) > MOST_TEXT:
        raise RuntimeError("text too large")
    return data


def joined(parts: Iterator[str]) -> str:
    """Texts of an archive's members, parted by spaces; white space is one space."""
    out, total = [], 0
    for part in parts:
        total += len(part)
        if total > MOST_TEXT:
            raise RuntimeError("text too large")
        out.append(part)
    return " ".join(" ".join(out).split())


def markup(text: str) -> str:
    text = re.sub("<[^>]+>", "", text)
    for entity, character in _ENTITIES:
        text = text.replace(entity, character)
    return " ".join(text.split())


def xml_text(data: bytes) -> str:
    """The trimmed text nodes of a document, or its text without tags where it cannot be parsed."""
    try:
        return " ".join(t.strip() for t in ET.fromstring(data).itertext() if t.strip())
    except ET.ParseError:
        return markup(plain(data))


def _opened_zip(file: BinaryIO) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(file)
    except zipfile.BadZipFile:
        raise RuntimeError("bad zip") from None


def _members(file: BinaryIO, wanted) -> str:
    with _opened_zip(file) as z:
        return joined(xml_text(whole(z.open(n))) for n in sorted(z.namelist()) if wanted(n.lower()) and not n.endswith("/"))


def mhtml(data: bytes) -> str:
    message = email.message_from_bytes(data, policy=email.policy.default)
    parts = [p.get_payload(decode=True) or b"" for p in message.walk() if p.get_content_type() in ("text/html", "text/plain")]
    return markup("\n".join(map(plain, parts)))


def _on_disk(file: BinaryIO, folder: str, suffix: str) -> str:
    """A path under which other programs can read a file; one that is on disk already is not copied."""
    name = getattr(file, "name", None)
    if isinstance(name, str) and os.path.isfile(name) and name.lower().endswith(suffix):
        return name
    path = os.path.join(folder, f"in{suffix}")
    with open(path, "wb") as f:
        shutil.copyfileobj(file, f, 1 << 20)
    return path


def _tool(names: list[list[str]], file: BinaryIO, suffix: str, seconds: float, out: str | None = None) -> str:
    """The output of the first of some programs that is installed and succeeds; {} stands for the file, {out} for its result."""
    there = [c for c in names if shutil.which(c[0])]
    if not there:
        raise Unsupported(f"{names[0][0]} not available")
    last = ""
    with tempfile.TemporaryDirectory() as folder:
        source, result = _on_disk(file, folder, suffix), os.path.join(folder, f"out{out or '.txt'}")
        for command in there:
            with open(os.path.join(folder, "said"), "w+b") as said:
                done = subprocess.run([source if a == "{}" else result if a == "{out}" else a for a in command], stdout=said, stderr=subprocess.PIPE, timeout=seconds)
                said.seek(0)
                if done.returncode == 0:
                    if "{out}" in command:
                        with open(result, "rb") as f:
                            return plain(whole(f))
                    return plain(whole(said))
            last = plain(done.stderr).strip()
    raise RuntimeError(last or f"{there[-1][0]} failed")


def _passed_over(suffix: str) -> bool:
    return not suffix or suffix in NOISE or suffix in ARCHIVES


class _Limits:
    """Counts an archive's members and bytes, and watches the time."""

    def __init__(self, deadline: float):
        self.deadline, self.members, self.bytes = deadline, 0, 0

    def member(self, size: int) -> None:
        self.members += 1
        self.bytes += size
        if self.members > MOST_MEMBERS or self.bytes > MOST_BYTES:
            raise RuntimeError("archive too large")
        if time.monotonic() > self.deadline:
            raise RuntimeError("archive timed out")


def _archive(file: BinaryIO, deadline: float) -> str:
    """The text of a zip archive's members in their order; nested archives and what cannot be read are left out."""
    limits = _Limits(deadline)

    def parts(z: zipfile.ZipFile) -> Iterator[str]:
        for i in z.infolist():
            if i.is_dir() or i.flag_bits & 1 or _passed_over(os.path.splitext(i.filename)[1].lower()):
                continue
            limits.member(i.file_size)
            try:
                member = z.open(i)
            except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
                continue
            with member:
                text, status = extract(i.filename, member, deadline)
            if status == "ok":
                yield text

    with _opened_zip(file) as z:
        return joined(parts(z))


def _unpacked(file: BinaryIO, deadline: float) -> BinaryIO:
    """The content of all streams of a bz2 file, one after the other; what follows them and is no stream is left out."""
    out, total, ended, data = tempfile.SpooledTemporaryFile(IN_MEMORY), 0, 0, file.read(1 << 20)  # noqa: SIM115  the caller closes it
    while data:
        unpack = bz2.BZ2Decompressor()
        fresh = True
        try:
            part = unpack.decompress(data, 1 << 20)
            while True:
                fresh = fresh and not part and not unpack.eof
                total += len(part)
                if total > MOST_BYTES:
                    raise RuntimeError("archive too large")
                if time.monotonic() > deadline:
                    raise RuntimeError("archive timed out")
                out.write(part)
                if unpack.eof:
                    break
                more = b""
                if unpack.needs_input:
                    more = file.read(1 << 20)
                    if not more:
                        raise RuntimeError("compressed data are cut off")
                part = unpack.decompress(more, 1 << 20)
        except OSError:
            if fresh and ended:
                break
            raise
        ended += 1
        data = unpack.unused_data or file.read(1 << 20)
    out.seek(0)
    return out


def _bz2(name: str, file: BinaryIO, deadline: float) -> str:
    limits = _Limits(deadline)

    def parts(t: tarfile.TarFile) -> Iterator[str]:
        for m in t:
            if not m.isfile() or _passed_over(os.path.splitext(m.name)[1].lower()):
                continue
            limits.member(m.size)
            with t.extractfile(m) as member:
                text, status = extract(m.name, member, deadline)
            if status == "ok":
                yield text

    with _unpacked(file, deadline) as inner:
        try:
            with tarfile.open(fileobj=inner) as t:
                return joined(parts(t))
        except tarfile.ReadError:
            inner.seek(0)
            text, status = extract(os.path.splitext(name)[0], inner, deadline)
            if status not in ("ok", "empty"):
                raise Unsupported(status.partition(": ")[2]) from None
            return text


def _seven(file: BinaryIO, deadline: float) -> str:
    tool = next((t for t in ("7z", "7za", "7zr", "bsdtar") if shutil.which(t)), None)
    if tool is None:
        raise Unsupported("7z not available")
    limits = _Limits(deadline)
    with tempfile.TemporaryDirectory() as folder:
        source, target = _on_disk(file, folder, ".7z"), os.path.join(folder, "out")
        os.mkdir(target)
        command = ["bsdtar", "-xf", source, "-C", target] if tool == "bsdtar" else [tool, "x", "-y", f"-o{target}", source]
        subprocess.run(command, capture_output=True, timeout=max(1.0, deadline - time.monotonic()), check=True)

        def parts() -> Iterator[str]:
            for p in sorted(os.path.join(d, n) for d, _, names in os.walk(target) for n in names):
                if _passed_over(os.path.splitext(p)[1].lower()):
                    continue
                limits.member(os.path.getsize(p))
                with open(p, "rb") as f:
                    text, status = extract(p, f, deadline)
                if status == "ok":
                    yield text

        return joined(parts())


def _read(name: str, file: BinaryIO, deadline: float) -> str:
    suffix = os.path.splitext(name)[1].lower()
    if suffix in TEXT:
        return plain(whole(file))
    if suffix in MARKUP:
        return markup(plain(whole(file)))
    if suffix == ".epub":
        return _members(file, lambda n: n.endswith((".xhtml", ".html", ".htm", ".xml")))
    if suffix == ".docx":
        return _members(file, lambda n: n.startswith("word/") and n.endswith(".xml"))
    if suffix == ".pptx":
        return _members(file, lambda n: n.startswith("ppt/slides/") and n.endswith(".xml"))
    if suffix == ".odt":
        return _members(file, lambda n: n == "content.xml")
    if suffix == ".pdf":
        return _tool([["pdftotext", "-layout", "{}", "-"]], file, suffix, 60)
    if suffix == ".doc":
        return _tool([["textutil", "-convert", "txt", "-stdout", "{}"], ["antiword", "{}"], ["catdoc", "{}"]], file, suffix, 60)
    if suffix in MHTML:
        return mhtml(whole(file))
    if suffix in CONVERTED:
        return _tool([["ebook-convert", "{}", "{out}"]], file, suffix, 180)
    if suffix == ".zip":
        return _archive(file, deadline)
    if suffix == ".bz2":
        return _bz2(name, file, deadline)
    if suffix == ".7z":
        return _seven(file, deadline)
    raise Unsupported(suffix or "no extension")


def extract(name: str, source: bytes | BinaryIO | None, deadline: float | None = None) -> tuple[str, str]:
    """(text, status) of a file, given as bytes or as an open file at its start; None is an error.

    A text over MOST_TEXT bytes, an archive over its limits and whatever else goes wrong give a status of their own.
    """
    if source is None:
        return "", "error: unreadable"
    file = io.BytesIO(source) if isinstance(source, bytes) else source
    try:
        text = _read(name, file, time.monotonic() + MOST_SECONDS if deadline is None else deadline)
    except Unsupported as e:
        return "", f"unsupported: {e}"
    except RuntimeError as e:
        return "", f"error: {e or type(e).__name__}"
    except Exception as e:  # noqa: BLE001  a file that cannot be read must not end the scan
        return "", f"error: extraction failed: {e or type(e).__name__}"
    return (text, "ok") if text.strip() else ("", "empty")
