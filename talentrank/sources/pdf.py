"""Text of PDF and old Word files: a chain of readers, each asked where the one before gives broken text."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Sequence

Reader = Callable[[bytes], str]


def broken(text: str) -> bool:
    """Empty, or over 10 lines of which over 40 % have at most 2 characters."""
    lines = text.split("\n")
    return not text.strip() or len(lines) > 10 and sum(len(x.strip()) <= 2 for x in lines) > 0.4 * len(lines)


def chain(data: bytes, readers: Sequence[Reader]) -> str:
    """The first reader's text that isn't broken; else the last one that any gave. A reader that fails or lacks its library is passed over."""
    last = ""
    for read in readers:
        try:
            text = read(data)
        except Exception:  # noqa: BLE001, S112  readers of broken files fail in any way
            continue
        if text and not broken(text):
            return text
        last = text or last
    return last


def block_reader(data: bytes) -> str:
    """Blocks of text in reading order, where the library for it is installed."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return "\n\n".join(b[4].strip() for page in doc for b in sorted((b for b in page.get_text("blocks") if b[6] == 0 and b[4].strip()), key=lambda b: (round(b[1] / 10), b[0])))


def flow_reader(data: bytes) -> str:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return "\n".join(page.get_text("text", sort=True) for page in doc)


def tolerant_reader(x: int, y: int) -> Reader:
    """Characters within so many points are one word or line."""

    def read(data: bytes) -> str:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return "".join(f"{t}\n" for page in pdf.pages if (t := page.extract_text(x_tolerance=x, y_tolerance=y)))

    return read


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\b(?:Td|TD|Tm|ET)\b|T\*|'|-?\d+(?:\.\d+)?(?=\s*[\(\]])", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def plain_reader(data: bytes) -> str:
    """Strings that the page streams show, line by line; for files with simple encodings, with the standard library alone."""
    out = []
    for m in _STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        for token in _SHOWN.findall(body):
            if token.startswith(b"("):
                text = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), token[1:-1], flags=re.DOTALL)
                out.append(text.decode("latin-1"))
            elif token[-1:].isdigit():
                if float(token) < -200:  # a wide gap inside an array of strings
                    out.append(" ")
            else:
                out.append("\n")
    return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


#: Readers in the order in which they are asked.
READERS: tuple[Reader, ...] = (block_reader, flow_reader, tolerant_reader(2, 3), tolerant_reader(15, 10), plain_reader)


def pdf_text(data: bytes, readers: Sequence[Reader] = READERS) -> str:
    return chain(data, readers)


def doc_text(data: bytes, tool: str = "catdoc") -> str:
    """Text of an old Word file by an external tool, '' where it isn't installed or fails."""
    found = shutil.which(tool)
    if not found:
        return ""
    with tempfile.NamedTemporaryFile(suffix=".doc") as f:  # the tool reads files; the task alone sees it
        f.write(data)
        f.flush()
        done = subprocess.run([found, f.name], capture_output=True, timeout=60, check=False)  # noqa: S603
    return done.stdout.decode("utf-8", "ignore") if done.returncode == 0 else ""
