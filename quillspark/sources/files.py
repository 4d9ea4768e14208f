"""Files as pages: text, Markdown, Word documents and archives, read by executors.

What can't be read is a row with a reason, never an error that ends the job. PDF needs an
optional parser and is reported as unsupported where there is none.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Limits on what an archive may expand to, and how much is inflated at once.
MOST_MEMBERS, MOST_RATIO, MOST_MEMBER, MOST_EXPANDED, CHUNK = 200, 200, 50 << 20, 200 << 20, 1 << 16
PAGES = "path string, name string, page int, kind string, text string, sha256 string, encoding string, reason string"
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Word features whose text a plain reader would misread.
REFUSED = ("drawing", "pict", "ins", "del", "fldSimple", "fldChar", "object")


def decoded(content: bytes) -> tuple[str, str]:
    """Text and encoding by byte order mark, else strict UTF-8. Raises ValueError; never guesses."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content.decode(name), name
    return content.decode("utf-8"), "utf-8"


def inflated(archive: zipfile.ZipFile, member: zipfile.ZipInfo, left: int) -> bytes:
    """A member's content, inflated step by step and counted as it comes, whatever its header says.
    Raises ValueError once it passes MOST_MEMBER or left, and where the header gave another size."""
    most, declared, out = min(MOST_MEMBER, left), member.file_size, bytearray()
    member.file_size = most + 2 * CHUNK  # a reader stops at the size that the header gives
    with archive.open(member) as f:
        while part := f.read(CHUNK):
            out += part
            if len(out) > most:
                raise ValueError("too large when expanded")
    if len(out) != declared:
        raise ValueError("header gives another size")
    return bytes(out)


def word_blocks(content: bytes) -> list[str]:
    """Paragraphs of a Word file: the main story first, then others by name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        left = MOST_EXPANDED
        if sum(i.file_size for i in z.infolist()) > left or len(z.infolist()) > 10 * MOST_MEMBERS:
            raise ValueError("too large when expanded")
        stories = sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", n))
        out = []
        for name in ["word/document.xml", *stories]:
            data = inflated(z, z.getinfo(name), left)
            left -= len(data)
            if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
                raise ValueError("declares entities")
            root = ElementTree.fromstring(data)
            for tag in REFUSED:
                if root.find(f".//{WORD}{tag}") is not None:
                    raise ValueError(f"holds {tag}")
            for p in root.iter(f"{WORD}p"):
                text = "".join("\t" if t.tag == f"{WORD}tab" else "\n" if t.tag == f"{WORD}br" else t.text or "" for t in p.iter() if t.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br"))
                if text.strip():
                    out.append(text)
    return out


def members(content: bytes) -> Iterator[tuple[str, bytes | None, str]]:
    """Name, content and reason of an archive's members; one that is skipped has no content. What
    the headers say is held against the limits before anything is inflated, and what comes
    out again while it is; a broken member costs only itself."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        inside = [i for i in z.infolist() if not i.is_dir()]
        if len(inside) > MOST_MEMBERS:
            raise ValueError("too many members")

        def why(i: zipfile.ZipInfo) -> str:
            suffix = i.filename.rpartition(".")[2].lower()
            if suffix not in ("txt", "md", "docx"):
                return "nested archive" if suffix == "zip" else "unsupported type"
            return "too large" if i.file_size > MOST_MEMBER else "expands too much" if i.file_size > MOST_RATIO * max(1, i.compress_size) else ""

        reasons = [why(i) for i in inside]
        left = MOST_EXPANDED
        if sum(i.file_size for i, r in zip(inside, reasons, strict=True) if not r) > left:
            raise ValueError("too large when expanded")
        for i, reason in zip(inside, reasons, strict=True):
            data = None
            if not reason:
                try:
                    data = inflated(z, i, left)
                    left -= len(data)
                except (ValueError, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError) as e:
                    reason = str(e)[:200] or type(e).__name__
            yield i.filename, data, reason


def pages_of(path: str, name: str, content: bytes) -> Iterator[tuple]:
    suffix, sha = name.rpartition(".")[2].lower(), hashlib.sha256(content).hexdigest()
    try:
        if suffix == "zip":
            for inner, data, why in members(content):
                if data is None:
                    yield path, inner, 0, "", None, None, None, why
                else:
                    yield from pages_of(path, inner, data)
        elif suffix in ("txt", "md"):
            text, encoding = decoded(content)
            yield path, name, 1, "page", text, sha, encoding, ""
        elif suffix == "docx":
            for k, text in enumerate(word_blocks(content), 1):
                yield path, name, k, "block", text, sha, "utf-8", ""
        else:
            yield path, name, 0, "", None, sha, None, "unsupported type"
    except (ValueError, KeyError, RuntimeError, EOFError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError) as e:
        yield path, name, 0, "", None, sha, None, str(e)[:200] or type(e).__name__


def read_pages(spark: SparkSession, path: str, pattern: str = "*.{txt,md,docx,zip,pdf}") -> DataFrame:
    """Pages of all files below path, with what was skipped and why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f.path, f.content, strict=True):
                yield pd.DataFrame(list(pages_of(p, p.rpartition("/")[2], bytes(c))), columns=[x.split()[0] for x in PAGES.split(", ")])

    return files.mapInPandas(run, PAGES)


class Refused(ValueError):
    """A strict reader's reason."""


def strict_json(text: str, depth: int = 64, items: int = 20_000) -> object:
    """JSON whose root is an object or a list: no repeated keys, no NaN or infinity, no lone
    surrogates, bounded depth and number of items. Raises Refused."""
    count = 0

    def pairs(found: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in found}) < len(found):
            raise Refused("repeated key")
        return dict(found)

    def constant(name: str) -> None:
        raise Refused(f"{name} isn't a number")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except Refused:
        raise
    except (ValueError, RecursionError) as e:
        raise Refused("not JSON") from e
    if not isinstance(value, dict | list):
        raise Refused("root isn't an object or a list")
    stack = [(value, 1)]
    while stack:
        v, d = stack.pop()
        count += 1
        if d > depth or count > items:
            raise Refused("too deep" if d > depth else "too many items")
        if isinstance(v, float) and v in (float("inf"), float("-inf")):
            raise Refused("infinite")
        if isinstance(v, str) and any(0xD800 <= ord(c) < 0xE000 for c in v):
            raise Refused("lone surrogate")
        stack += [(x, d + 1) for x in (list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else [])]
        if isinstance(v, dict):
            stack += [(k, d + 1) for k in v]
    return value
