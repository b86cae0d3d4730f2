"""Interleaved document sequences with media columns.

``parse_sequences`` turns HTML into ordered structs of text and media references; ``resolve`` joins the references with
a media table by digest and puts the sequences together again, so that positions and captions stay aligned with what
was resolved. ``stored_payloads`` keeps byte payloads as lossless 8-bit grey images (PNG, 64 samples a row) in a
content-addressed media table.

Defined results: null HTML gives an empty sequence; an image without a digest, or whose digest no media row has, stays
in its place with null media columns; equal payloads of a task's batch are stored once, and again only by another task,
with the same digest and bytes, so that no payload is shuffled; measures have one row per digest; a null or empty payload is one row of 64 zero
bytes; repeated pages keep their own rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.llm.staging import staged

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256/"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "br", "blockquote", "pre", "figure", "header", "footer", "main", "nav"}
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img", "video", "audio", "source", "embed"}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey image of 64 samples a row; the payload's length must be a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made, with all its checksums tested."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, width = 8, [], None
    while at < len(image):
        length, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8:at + 8 + length]
        if struct.unpack_from(">I", image, at + 8 + length)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", data)[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered PNG rows")
    return lines[:, 1:].tobytes()


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = self.captioning = 0
        self.caption: list[str] = []
        self.figure_from: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.captioning, self.caption = 1, []
        elif tag in MEDIA:
            values = dict(attrs)
            source = values.get("src") or ""
            if tag == "source" and not source:
                return
            self.flush()
            digest = source[len(SCHEME):] if source.startswith(SCHEME) else None
            self.items.append({"kind": "media", "text": None, "digest": digest, "caption": values.get("alt") or None})
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure_from = len(self.items)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.captioning = 0
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figure_from is not None:
                caption = " ".join("".join(self.caption).split())
                for item in self.items[self.figure_from:]:
                    if item["kind"] == "media" and caption:
                        item["caption"] = caption
                self.figure_from, self.caption = None, []

    def handle_data(self, data):
        if self.hidden:
            return
        (self.caption if self.captioning else self.words).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """Text runs and media references of a page in document order, numbered from 0; a figure's caption is its media's."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def parse_sequences(pages: DataFrame, html: str = "html", sequence: str = "sequence") -> DataFrame:
    """Adds the ordered sequence of every page's text and media references."""
    @F.pandas_udf(ITEMS)
    def parsed(column):
        return column.map(sequence_of)

    return pages.withColumn(sequence, parsed(F.col(html)))


def resolve(pages: DataFrame, media: DataFrame, keys: list[str], sequence: str = "sequence") -> DataFrame:
    """The pages with a sequence whose items carry a struct ``media`` with the columns of the media row of their digest,
    which the media table may hold as text or as bytes.

    ``keys`` identify a page. Only references leave their page: they are joined by digest, a hot digest being split by
    adaptive execution, and what is found comes back by position, so positions and captions stay with their media.
    """
    binary = media.schema["digest"].dataType.typeName() == "binary"
    items = pages.select(*keys, F.inline(F.filter(sequence, lambda i: i["digest"].isNotNull())))
    references = items.select(*keys, "position", (F.unhex("digest") if binary else F.col("digest")).alias("_digest"))
    found = media.select(F.col("digest"), F.struct(*[c for c in media.columns if c != "digest"]).alias("_media"))
    by_page = (
        references.join(found, F.col("_digest") == F.col("digest")).groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
        .agg(F.map_from_entries(F.collect_list(F.struct("position", "_media"))).alias("_found"))
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    names = ("position", "kind", "text", "digest", "caption")
    filled = F.transform(sequence, lambda i: F.struct(*[i[c].alias(c) for c in names], F.col("_found")[i["position"]].alias("media")))
    return pages.join(by_page, same, "left").withColumn(sequence, filled).drop("_found", *[f"_key_{k}" for k in keys])


def payload_of(text: Column) -> Column:
    """UTF-8 bytes with zero bytes appended up to a positive multiple of 64."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    fill = F.when(n == 0, F.lit(WIDTH)).otherwise((WIDTH - n % WIDTH) % WIDTH)
    return F.concat(data, F.substring(F.lit(bytes(WIDTH)), F.lit(1), fill))


def features_of(payload: bytes) -> str:
    """Rows, mean, deviation, entropy in bits and the share of equal neighbours of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    levels = np.arange(256)
    mean = float((counts * levels).sum() / len(samples))
    deviation = float(np.sqrt((counts * (levels - mean) ** 2).sum() / len(samples)))
    entropy = max(0.0, float(-(share * np.log2(share)).sum()))
    alike = float((samples[1:] == samples[:-1]).mean())
    return f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.4f};sd={deviation:.4f};bits={entropy:.4f};alike={alike:.4f}"


def stored_payloads(payloads: DataFrame) -> DataFrame:
    """The media table of a column ``payload``: digest and stored image of every payload, written once."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[str] = set()
            for at in range(0, len(batch), 256):
                images = {}
                for value in batch["payload"].slice(at, 256):
                    payload = value.as_py()
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in seen:
                        seen.add(digest)
                        images[digest] = to_png(payload)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(images), pa.string()), pa.array(list(images.values()), pa.binary())], ["digest", "image"]
                )

    return staged(payloads.select("payload").mapInArrow(store, "digest string, image binary"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """Measures of the stored images, from their bytes, one row per digest; digests are binary, as they travel.

    An image whose samples don't have the digest it is stored under raises ValueError.
    """
    schema = "digest binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch["digest"].to_pylist(), batch["image"]):
                image = image.as_py()
                payload = from_png(image)
                found = hashlib.sha256(payload)
                if found.hexdigest() != digest:
                    raise ValueError(f"the image stored under {digest} has other samples")
                rows.append((
                    found.digest(), len(payload), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).digest(), features_of(payload),
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], [c.split()[0] for c in schema.split(", ")],
            )

    measures = media.mapInArrow(read, schema)
    return measures.groupBy("digest").agg(*[F.first(c).alias(c) for c in measures.columns if c != "digest"])


def _figure(payload: Column, caption: Column) -> Column:
    return F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(payload, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))


def page_of(text: Column, payload: Column, tail: Column) -> Column:
    """A page of a text: its lines as paragraphs, the figure of its payload in their middle, that of the tail at the end."""
    text = F.coalesce(text, F.lit(""))
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(escaped, "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    some = lambda first, n: F.concat(F.lit("<p>"), F.array_join(F.slice(lines, first, n), "</p><p>"), F.lit("</p>"))
    caption = F.concat(F.lit("text of "), F.octet_length(text).cast("string"), F.lit(" bytes"))
    return F.concat(
        F.lit("<article>"), some(F.lit(1), half), _figure(payload, caption), some(half + 1, F.size(lines) - half),
        _figure(tail, F.lit("its last samples")), F.lit("</article>"),
    )


def document_media(documents: DataFrame) -> DataFrame:
    """Every text as a page of text runs and two media, its payload and the payload's last row: written as HTML, parsed
    into a sequence, resolved by digest, and measured from what the resolved media have stored.

    One row per document with doc_id, n_bytes, the measures of the payload's medium, and the places and captions of the
    two media among the page's items. Text runs are counted where they are parsed; only references travel, with their places.
    """
    payload = payload_of(F.col("text"))
    tail = F.substring(payload, -WIDTH, WIDTH)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    both = documents.select(F.explode(F.array(payload, tail)).alias("payload"))
    media = staged(read_back(stored_payloads(both)), "measures")  # so a hot digest's join can split
    pages = documents.select("doc_id", n_bytes.alias("n_bytes"), page_of(F.col("text"), payload, tail).alias("html"))
    is_media = lambda i: i["kind"] == "media"
    parsed = parse_sequences(pages).select(
        "doc_id", "n_bytes", F.size("sequence").alias("items"),
        F.aggregate("sequence", F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.length(i["text"]), F.lit(0))).alias("text_chars"),
        F.filter("sequence", is_media).alias("sequence"),
    ).withColumn("page", F.monotonically_increasing_id())
    resolved = resolve(staged(parsed, "pages"), media, ["page"])
    whole, last = F.element_at("sequence", 1), F.element_at("sequence", 2)
    return resolved.select(
        "doc_id", "n_bytes", whole["media"]["payload_bytes"].alias("payload_bytes"),
        F.when(whole["media"].isNotNull(), whole["digest"]).alias("payload_sha256"),  # what was read back has this digest
        last["media"]["tail_crc32"].alias("tail_crc32"), whole["media"]["media_bytes"].alias("media_bytes"),
        F.lower(F.hex(whole["media"]["media_sha256"])).alias("media_sha256"), whole["media"]["feature"].alias("feature"),
        whole["position"].alias("position"), whole["caption"].alias("caption"), last["position"].alias("tail_position"),
        last["caption"].alias("tail_caption"), "items", "text_chars",
    )
