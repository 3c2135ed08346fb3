"""Bank statements as PDF files, made of rows: input for the queries and tests of the PDF source."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _escaped(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"


def _text(x: float, y: float, text: str) -> bytes:
    return b"BT /F1 9 Tf %.1f %.1f Td %s Tj ET\n" % (x, y, _escaped(text))


def page(title: str, rows: list[tuple[str, ...]], ruled: bool) -> bytes:
    """Content of a page: a title, rows as a ruled table or as lines, a footer."""
    edges, top = [40, 130, 400, 480], 720
    out = [_text(40, 760, title), _text(40, 30, "Questions? Call us")]
    for i, row in enumerate(rows):
        y = top - 16 * (i + 1)
        out += [_text(edges[j] + 4, y + 5, cell) for j, cell in enumerate(row)] if ruled else [_text(40, y + 5, " ".join(row))]
    if ruled:
        bottom = top - 16 * len(rows)
        out += [b"%d %d m %d %d l S\n" % (edges[0], top - 16 * i, edges[-1], top - 16 * i) for i in range(len(rows) + 1)]
        out += [b"%d %d m %d %d l S\n" % (x, bottom, x, top) for x in edges]
    return b"".join(out)


def pdf(pages: list[bytes], packed: bool = False) -> bytes:
    """A file of these pages: plain with a cross-reference table, or packed with object and cross-reference streams."""
    n = len(pages)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (n, b" ".join(b"%d 0 R" % (4 + i) for i in range(n)))}
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    objects |= {4 + i: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R >>" % (4 + n + i) for i in range(n)}
    stream = lambda about, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (about, len(data), data)
    streams = {4 + n + i: stream(b"/Filter /FlateDecode", zlib.compress(p)) if packed else stream(b"", p) for i, p in enumerate(pages)}
    out, places = bytearray(b"%PDF-1.5\n"), {}
    if packed:
        head, body = [], b""
        for k, x in objects.items():
            head.append(b"%d %d" % (k, len(body)))
            body += x + b" "
        first = b" ".join(head) + b" "
        holder = 4 + 2 * n
        streams[holder] = stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(objects), len(first)), zlib.compress(first + body))
        places = {k: (2, holder, i) for i, k in enumerate(objects)}
        objects = {}
    for k, x in (objects | streams).items():
        places[k] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, x)
    at = len(out)
    if packed:
        size = max(places) + 2
        places[size - 1] = (1, at, 0)
        table = b"".join(bytes([a]) + b.to_bytes(4) + c.to_bytes(2) for a, b, c in (places.get(k, (0, 0, 0)) for k in range(size)))
        rows = b"".join(b"\2" + bytes((table[r * 7 + i] - (table[r * 7 - 7 + i] if r else 0)) & 255 for i in range(7)) for r in range(size))
        out += b"%d 0 obj\n%s\nendobj\n" % (size - 1, stream(b"/Type /XRef /Size %d /Root 1 0 R /W [1 4 2] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % size, zlib.compress(rows)))
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1)
        out += b"".join(b"%010d 00000 n \n" % places[k][1] for k in range(1, len(places) + 1)) + b"trailer\n<< /Size %d /Root 1 0 R >>\n" % (len(places) + 1)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def written(rows: DataFrame) -> DataFrame:
    """(path, content) of statements of rows (path, page, ruled, packed, nth, title, cells array): a file per path, a page per number, rows in order of nth.
    A statement is as long as one. Files are work, not bytes, so they are spread over all tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.repartition(n, "path").groupBy("path").agg(F.max("packed").alias("packed"), F.sort_array(F.collect_list(F.struct("page", "nth", "ruled", "title", "cells"))).alias("rows"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for packed, found in zip(b.column("packed").to_pylist(), b.column("rows").to_pylist(), strict=True):
                pages: dict[int, list[dict]] = {}
                for r in found:
                    pages.setdefault(r["page"], []).append(r)
                files.append(pdf([page(p[0]["title"], [tuple(r["cells"]) for r in p], p[0]["ruled"]) for p in pages.values()], packed))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(files, pa.binary())], ["path", "content"])

    return each.mapInArrow(work, "path string, content binary")
