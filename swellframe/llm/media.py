"""Media columns: documents as interleaved sequences of text and media, with payloads in a media table by digest.

`interleaved` parses HTML into ordered structs: position, kind (text or media), text, ref, digest, caption. A media element's
digest is that of a `sha256:` reference; its caption is the figcaption of the innermost figure around it that has one, before it or after it, else its
alt text. A figcaption outside of figures is text. References that are loaded late, of objects and posters, and the largest candidates of a srcset count too.
What scripts, styles, templates and noscripts hold is skipped, text and media; a template or noscript that never ends skips nothing. `resolved`
joins media rows to the structs by digest (structs without one are spread, and find nothing); each row keeps its position and caption, so alignment doesn't depend on the join.
A digest that a third of all documents share is one media row, and the references to it are split (skew join).

`stored_payloads` keeps texts losslessly as 8-bit grey PNG images of 192 samples a row in a media table; `read_back` decodes the stored
bytes and computes features of the samples. Bytes are written once per task and distinct payload, and never shuffled.

Defined results: null html has no structs; null text is an empty payload; equal payloads have equal values; rows are
kept as they come, repeats and null ids too; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, slices, stored

#: Samples of an image row; payloads are padded with spaces to a positive multiple.
ROW = 192
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of html or payload that are Python objects at once.
SLICE = 4 << 20
STRUCTS = "array<struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>>"
#: Attributes that hold a reference, in the order they are tried.
MEDIA_TAGS = {"img": ("src", "data-src"), "video": ("src", "data-src"), "audio": ("src", "data-src"), "source": ("src", "data-src"), "embed": ("src",), "object": ("data",)}
#: Attributes that list candidates with their widths or densities.
CANDIDATES = ("srcset", "data-srcset")
SKIPPED_TAGS = {"script", "style", "template", "noscript"}
BLOCK_TAGS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "figure", "table", "tr", "td", "th", "blockquote", "pre", "nav", "header", "footer", "figcaption"}


def largest_candidate(srcset: str | None) -> str | None:
    """The reference of a srcset with the largest width or density, the first of equals; its references hold no white space."""
    best, largest = None, -1.0
    for found in re.finditer(r"[\s,]*(\S*[^\s,])(?:\s+([0-9.]+)[wx])?[^,\S]*(?:,|$|(?=\s))", srcset or ""):
        try:
            size = float(found[2] or 1)
        except ValueError:
            continue
        if size > largest:
            best, largest = found[1], size
    return best


def reference(tag: str, a: dict) -> str | None:
    """What a media element refers to: its source; the one that is loaded late where the source is inline or not there; else its largest candidate."""
    every = [a[c].strip() for c in MEDIA_TAGS[tag] if (a.get(c) or "").strip()]
    every += [c for c in (largest_candidate(a.get(x)) for x in CANDIDATES) if c]
    return next((x for x in every if x[:5].lower() != "data:"), every[0] if every else None)


class _Sequence(HTMLParser):
    """Parts in order; `figures` holds the figure around each figure (or none) and its caption, `within` those that are open. Work is linear in the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[dict] = []
        self.within: list[int] = []
        self.skipped: list[tuple[str, int]] = []
        self.open = dict.fromkeys(SKIPPED_TAGS, 0)
        self.held: list[tuple] = []
        self.unclosed: set[int] = set()
        self.at = 0

    def flush(self):
        if own := " ".join("".join(self.text).split()):
            self.parts.append({"kind": "text", "text": own, "ref": None, "digest": None, "caption": None})
        self.text = []

    def hold(self, *event) -> bool:
        """Whether an event is part of a skipped element; such events are kept until the element ends."""
        kind, tag = event[0], event[1]
        self.at += 1
        if kind == "start" and tag in SKIPPED_TAGS and self.at not in self.unclosed:
            self.skipped.append((tag, self.at))
            self.open[tag] += 1
        elif kind == "end" and self.open.get(tag):
            while self.skipped:
                last, _ = self.skipped.pop()
                self.open[last] -= 1
                if last == tag:
                    break
            if not self.skipped:
                self.held = []
                return True
        if self.skipped:
            self.held.append((self.at, event))
        return bool(self.skipped)

    def handle_starttag(self, tag, attrs):
        if not self.hold("start", tag, attrs):
            self.started(tag, dict(attrs))

    def handle_endtag(self, tag):
        if not self.hold("end", tag):
            self.ended(tag)

    def handle_data(self, data):
        if not self.hold("data", data):
            (self.text if self.caption is None else self.caption).append(data)

    def close(self):
        """Skipped elements that never end don't take the rest of the page with them (script and style do, as in browsers)."""
        super().close()
        self.unclosed = {at for tag, at in self.skipped if tag not in ("script", "style")}
        if self.unclosed:
            again, self.held, self.skipped, self.open = self.held, [], [], dict.fromkeys(SKIPPED_TAGS, 0)
            for at, (kind, *event) in again:
                self.at = at - 1
                {"start": self.handle_starttag, "end": self.handle_endtag, "data": self.handle_data}[kind](*event)
        self.captioned()
        self.flush()
        inherited = []
        for figure in self.figures:
            around = None if figure["around"] is None else inherited[figure["around"]]
            inherited.append(around if figure["caption"] is None else " ".join(figure["caption"]).strip())
        for p in self.parts:
            if p["kind"] == "media" and p["figure"] is not None and inherited[p["figure"]] is not None:
                p["caption"] = inherited[p["figure"]]

    def captioned(self):
        """Ends a caption, if one is open: its figure's, or text where there is no figure."""
        if self.caption is None:
            return
        own, self.caption = " ".join("".join(self.caption).split()), None
        if self.within:
            figure = self.figures[self.within[-1]]
            if figure["caption"] is None:
                figure["caption"] = []
            figure["caption"].append(own)
        else:
            self.text.append(own)
            self.flush()

    def started(self, tag, a):
        if tag in ("figure", "figcaption"):
            self.captioned()
        if tag in BLOCK_TAGS or tag in MEDIA_TAGS:
            self.broken()
        if tag == "figure":
            self.figures.append({"around": self.within[-1] if self.within else None, "caption": None})
            self.within.append(len(self.figures) - 1)
        elif tag == "figcaption":
            self.caption = []
        if tag in MEDIA_TAGS:
            self.medium(reference(tag, a), a.get("alt"))
            if tag == "video":
                self.medium((a.get("poster") or "").strip(), a.get("alt"))

    def ended(self, tag):
        if tag in ("figcaption", "figure"):
            self.captioned()
        if tag in BLOCK_TAGS:
            self.broken()
        if tag == "figure" and self.within:
            self.within.pop()

    def broken(self):
        """A block or a medium parts the words on its sides."""
        if self.caption is not None:
            self.caption.append(" ")
        self.flush()

    def medium(self, ref, alt):
        if ref:
            digest = ref[7:].lower() if ref[:7].lower() == "sha256:" else None
            self.parts.append({"kind": "media", "text": None, "ref": ref, "digest": digest, "caption": alt, "figure": self.within[-1] if self.within else None})


def sequence(html: str | None) -> list[dict]:
    """The ordered text and media structs of a page."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    return [{"position": i, **{c: x[c] for c in ("kind", "text", "ref", "digest", "caption")}} for i, x in enumerate(p.parts)]


def interleaved(pages: DataFrame, html_col: str = "html", into: str = "sequence") -> DataFrame:
    """pages with the html column replaced by its sequence; other columns pass through."""
    rest = [c for c in pages.columns if c not in (html_col, into)]
    types = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "ref", "digest", "caption"))]))

    def parsed(batches):
        for batch in slices(batches, html_col, SLICE):
            made = pa.array([sequence(h) for h in batch.column(html_col).to_pylist()], types)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), made], names=[*rest, into])

    kinds = dict(pages.dtypes)
    return pages.select(*rest, html_col).mapInArrow(releasing(parsed), ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{into}` {STRUCTS}"]))


def resolved(sequences: DataFrame, media: DataFrame, column: str = "sequence") -> DataFrame:
    """A row per struct, with the media row of its digest (unique there) beside it; nulls where there is none."""
    rows = sequences.select("*", F.inline(column)).drop(column)
    key = F.coalesce("digest", F.concat(F.lit("none "), F.pmod(F.xxhash64("position", "text", "ref"), F.lit(4096))))
    return rows.withColumn("of digest", key).join(media.withColumnRenamed("digest", "of digest"), "of digest", "left").drop("of digest")


# --- payloads as images ---------------------------------------------------------------------------------------

def payload_of(text: Column) -> Column:
    """UTF-8 text with spaces up to a positive multiple of ROW bytes."""
    t = F.coalesce(text, F.lit(""))
    n = F.octet_length(t)
    pad = F.when(n == 0, ROW).otherwise((ROW - n % ROW) % ROW)
    return F.concat(t, F.repeat(F.lit(" "), pad)).cast("binary")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of an 8-bit grey image whose rows are unfiltered."""
    if data[:8] != PNG:
        raise ValueError("no PNG")
    at, packed, width = 8, [], 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            packed.append(body)
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and deviation in thousandths, and a 16-bin histogram in 255ths of its largest bin."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a >> 4, minlength=16)
    n, s, q = len(a), int(a.sum(dtype=np.int64)), int(np.square(a.astype(np.int64)).sum())
    return f"m{1000 * s // n}-d{1000 * round(max(0, q * n - s * s) ** 0.5) // n}-h" + bytes(int(255 * c // counts.max()) for c in counts).hex()


def stored_payloads(payloads: DataFrame) -> DataFrame:
    """digest, media (PNG): the media table, written. payloads: digest, payload. A task stores a digest once."""

    def encoded(batches):
        done = set()
        table = lambda d, m: pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(m, pa.binary())], names=["digest", "media"])
        for batch in batches:
            digests, images, size = [], [], 0
            for d, p in zip(batch.column("digest").to_pylist(), batch.column("payload"), strict=True):
                if d not in done:
                    done.add(d)
                    digests.append(d)
                    images.append(to_png(p.as_py()))
                    size += len(images[-1])
                    if size > SLICE:
                        yield table(digests, images)
                        digests, images, size = [], [], 0
            yield table(digests, images)

    return stored(payloads.select("digest", "payload").mapInArrow(releasing(encoded), "digest string, media binary"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each stored payload."""
    schema = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def decoded(batches):
        for batch in batches:
            rows = []
            for d, m in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                m = m.as_py()
                p = from_png(m)
                rows.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return stored(media.mapInArrow(releasing(decoded), schema).dropDuplicates(["digest"]), "media-features")


def documents_as_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back of the payload that the document's page refers to."""
    d = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), payload_of(F.col("text")).alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    media = read_back(stored_payloads(d))
    page = F.format_string('<article><p>%d bytes</p><figure><img src="sha256:%s"><figcaption>document %s</figcaption></figure></article>', "n_bytes", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    pages = interleaved(d.select("doc_id", "n_bytes", page.alias("html")))
    return resolved(pages, media).where("kind = 'media'").drop("position", "kind", "text", "ref", "digest")
