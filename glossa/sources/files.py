"""Reading and writing project files through Spark, so that paths may be in any store that Spark reads."""

from __future__ import annotations

import json
import math
import tempfile
import zipfile
from collections.abc import Iterable, Sequence
from typing import IO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file from the driver."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(data)
    out.close()


def write_stream(spark: SparkSession, path: str, data: IO[bytes], block: int = 1 << 20) -> None:
    """A file from the driver, by blocks."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    while part := data.read(block):
        out.write(part)
    out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


# ------------------------------------------------------------------ sources


def _single_byte(content: Column, encoding: str) -> Column:
    """Text of a single-byte encoding: as Latin-1, with the upper half put in place. Undefined bytes become U+FFFD."""
    upper = "".join(bytes([b]).decode(encoding, errors="replace") for b in range(128, 256))
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(128, 256))), upper)


def decoded(content: Column, encodings: tuple[str, ...]) -> Column:
    """struct(text, encoding) by the first encoding that fits, without a byte order mark; null if none does. Single-byte encodings fit where all bytes are defined."""
    out = []
    for e in encodings:
        if e.lower().replace("-", "").replace("_", "") in ("utf8", "utf8sig"):
            fits, text = F.is_valid_utf8(content.cast("string")), F.regexp_replace(F.decode(content, "UTF-8"), f"^{BOM}", "")
        else:
            text = _single_byte(content, e)
            fits = ~F.contains(text, F.lit("�"))
        out.append(F.when(fits, F.struct(text.alias("text"), F.lit(e).alias("encoding"))))
    return F.coalesce(*out)


def read_texts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "utf-8-sig", "cp1251")) -> DataFrame:
    """(doc_id, path, text, encoding, sha256) of each file of the path, numbered by path. A file that no encoding fits has a null text."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(path)
    rows = files.withColumn("d", decoded(F.col("content"), encodings))
    return rows.select((F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("doc_id"), "path", F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"), F.sha2("content", 256).alias("sha256"))


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file, empty if there is none."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0] if exists(spark, path) else ""


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all text: no byte order mark, nulls as empty text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip(BOM).strip() for c in df.columns]).fillna("")


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """A morphological dictionary: Parquet, or text of tab-separated columns with a header (form, lemma, and tags and weight or not). Lines are read where they lie: a file may be split."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, sep="\t", quote="", encoding="UTF-8")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value), a line each; no rows where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ord long, value string")
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", f"^{BOM}", "").alias("value"))


def read_csv_flexible(spark: SparkSession, path: str, encodings: tuple[str, ...], separators: tuple[str, ...] = (",", ";", "\t")) -> DataFrame:
    """A CSV table of unknown encoding and separator: the first separator that splits all of the first lines into as many fields, two at least; else the first. The head of one small file is looked at by the driver."""
    first = read_texts(spark, path, encodings).select("text", "encoding").first()
    if first is None or first["text"] is None:
        raise ValueError(f"no encoding of {encodings} fits {path}")
    head = [x for x in first["text"].splitlines()[:20] if x.strip()]
    widths = {s: {x.count(s) for x in head} for s in separators}
    sep = next((s for s in separators if len(widths[s]) == 1 and widths[s] != {0}), separators[0])
    lines = spark.createDataFrame([(x,) for x in first["text"].splitlines()], "value string")
    names = [c.strip() for c in head[0].split(sep)] if head else []
    parsed = lines.where(F.col("value") != (head[0] if head else "")).select(F.from_csv("value", F.lit(", ".join(f"`{c}` STRING" for c in names)), {"sep": sep}).alias("r"))
    return parsed.select("r.*")


def load_table(spark: SparkSession, stem: str, schema=None) -> DataFrame:
    """Parquet, else CSV, else the CSV sample."""
    stem = stem.removesuffix(".parquet").removesuffix(".csv")
    if exists(spark, f"{stem}.parquet"):
        return spark.read.parquet(f"{stem}.parquet")
    for end in (".csv", ".sample.csv"):
        if exists(spark, stem + end):
            return spark.read.csv(stem + end, header=True, multiLine=True, escape='"', schema=schema) if schema else read_lexicon(spark, stem + end)
    raise FileNotFoundError(stem)


def read_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    empty = "id string, lemma string, surface string, regex string, reason string, enabled string"
    return read_lexicon(spark, path) if path and exists(spark, path) else spark.createDataFrame([], empty)


# ------------------------------------------------------------------ sinks


def save_table(df: DataFrame, stem: str, export_csv: bool = False, csv_max_rows: int = 200_000, sample_rows: int = 50_000) -> str:
    """Parquet, and a CSV mirror if wanted: the whole table up to csv_max_rows, else a sample of its first rows. Gives the Parquet path."""
    save_observed(df, stem, {}, export_csv, csv_max_rows, sample_rows)
    return f"{stem.removesuffix('.parquet').removesuffix('.csv')}.parquet"


def save_observed(df: DataFrame, stem: str, metrics: dict[str, Column], export_csv: bool = False, csv_max_rows: int = 200_000, sample_rows: int = 50_000, names: dict[str, str] | None = None) -> dict[str, int]:
    """As save_table, columns renamed by `names`; gives the metrics (aggregates over df) and `rows`, which are taken while the table is written: nothing is read or counted a second time."""
    stem = stem.removesuffix(".parquet").removesuffix(".csv")
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])
    watched.withColumnsRenamed(names or {}).write.mode("overwrite").parquet(f"{stem}.parquet")
    found = seen.get
    if export_csv:
        kept = df.sparkSession.read.parquet(f"{stem}.parquet")
        small = found["rows"] <= csv_max_rows
        flat = kept.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in kept.dtypes])
        (flat if small else flat.limit(sample_rows)).write.mode("overwrite").csv(f"{stem}.csv" if small else f"{stem}.sample.csv", header=True, escape='"')
    return found


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


#: Rows that a sheet of an .xlsx can hold.
SHEET_ROWS = 1_048_576


def save_workbook(sheets: dict[str, DataFrame], path: str, xlsx: bool = True) -> None:
    """A Parquet folder for each sheet, and an .xlsx with all rows of each: the driver holds a part of a table at a time. A table of more rows than a sheet can hold goes on in further sheets."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    if xlsx and sheets:
        spark = next(iter(sheets.values())).sparkSession
        tables = ((name, spark.read.parquet(f"{path}/{name}.parquet")) for name in sheets)
        with tempfile.TemporaryFile() as f:
            write_workbook(f, ((name, df.columns, df.toLocalIterator()) for name, df in tables))
            f.seek(0)
            write_stream(spark, f"{path}.xlsx", f)


def write_workbook(f: IO[bytes], tables: Iterable[tuple[str, list[str], Iterable[Sequence]]], sheet_rows: int = SHEET_ROWS) -> None:
    """A minimal Office Open XML workbook of (name, columns, rows), written as the rows come."""
    main, rels = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names: list[str] = []

    def cell(v: object) -> str:
        if isinstance(v, bool) or v is None or not isinstance(v, int | float):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, columns, rows in tables:
            left, number = iter(rows), 1
            more: Sequence | None = columns
            while more is not None:
                names.append((name if number == 1 else f"{name[:27]}_{number}")[:31])
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    line = lambda r: f"<row>{''.join(map(cell, r))}</row>".encode()
                    out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode() + line(columns))
                    if number > 1:
                        out.write(line(more))
                    for _, row in zip(range(sheet_rows - 1 - (number > 1)), left, strict=False):
                        out.write(line(row))
                    out.write(b"</sheetData></worksheet>")
                more, number = next(left, None), number + 1
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in enumerate(names, 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>{sheets}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(names, 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{targets}</Relationships>')


# ------------------------------------------------------------------ figures, from a few rows each


def _svg(title: str, width: float, height: float, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif" font-size="12"><text x="20" y="24" font-size="16">{escape(title)}</text>{body}</svg>'


def _label(x: float, y: float, text: object, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(str(text))}</text>'


COLOURS = ("#4878a8", "#c8643c", "#5a9a5a", "#8a5aa8", "#b0903c", "#5aa0a8")


def bar_svg(title: str, rows: list[tuple[str, float]]) -> str:
    """A horizontal bar chart."""
    top, high = max([v for _, v in rows], default=0) or 1, 26
    bars = "".join(_label(290, 60 + i * high, k, "end") + f'<rect x="300" y="{47 + i * high}" width="{400 * v / top:.1f}" height="18" fill="{COLOURS[0]}"/>' + _label(306 + 400 * v / top, 60 + i * high, f"{v:g}") for i, (k, v) in enumerate(rows))
    return _svg(title, 780, 70 + high * len(rows), bars)


def heatmap_svg(title: str, rows: list[tuple[str, str, float]]) -> str:
    """Cells of (row, column, value), darker for more, each with its value."""
    down, across = list(dict.fromkeys(r for r, _, _ in rows)), list(dict.fromkeys(c for _, c, _ in rows))
    top = max([v for _, _, v in rows], default=0) or 1
    body = "".join(_label(190, 112 + 24 * i, r, "end") for i, r in enumerate(down)) + "".join(f'<g transform="translate({222 + 48 * j},90) rotate(-35)">{_label(0, 0, c)}</g>' for j, c in enumerate(across))
    for r, c, v in rows:
        x, y, shade = 200 + 48 * across.index(c), 96 + 24 * down.index(r), v / top
        body += f'<rect x="{x}" y="{y}" width="46" height="22" fill="{COLOURS[0]}" fill-opacity="{0.08 + 0.92 * shade:.3f}"/>' + _label(x + 23, y + 15, f"{v:g}", "middle")
    return _svg(title, 260 + 48 * len(across) + 120, 120 + 24 * len(down), body)


def line_svg(title: str, series: dict[str, list[tuple[str, float]]]) -> str:
    """A line with dots for each series over the same places in order."""
    places = list(dict.fromkeys(k for points in series.values() for k, _ in points))
    top = max([v for points in series.values() for _, v in points], default=0) or 1
    at = lambda k, v: (60 + 90 * places.index(k), 300 - 230 * v / top)
    body = "".join(_label(60 + 90 * i, 322, k, "middle") for i, k in enumerate(places)) + _label(50, 70, f"{top:g}", "end") + _label(50, 300, "0", "end")
    for i, (name, points) in enumerate(series.items()):
        colour, dots = COLOURS[i % len(COLOURS)], [at(k, v) for k, v in points]
        body += f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in dots)}"/>' + "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{colour}"/>' for x, y in dots)
        body += f'<rect x="{90 + 90 * len(places)}" y="{60 + 20 * i}" width="12" height="12" fill="{colour}"/>' + _label(108 + 90 * len(places), 71 + 20 * i, name)
    return _svg(title, 380 + 90 * len(places), 340, body)


def pie_svg(title: str, rows: list[tuple[str, float, bool]]) -> str:
    """Sectors of (label, value, whether it is labelled), clockwise from the top."""
    whole, turn, body = sum(v for _, v, _ in rows) or 1, 0.0, ""
    spot = lambda part, r: (220 + r * math.sin(2 * math.pi * part), 200 - r * math.cos(2 * math.pi * part))
    for i, (label, v, named) in enumerate(rows):
        share = v / whole
        (x, y), (x2, y2) = spot(turn, 140), spot(min(turn + share, turn + 0.9999), 140)
        body += f'<path d="M220,200 L{x:.1f},{y:.1f} A140,140 0 {int(share > 0.5)} 1 {x2:.1f},{y2:.1f} Z" fill="{COLOURS[i % len(COLOURS)]}" stroke="#fff"/>'
        if named:
            tx, ty = spot(turn + share / 2, 156)
            body += _label(tx, ty, f"{label} {100 * share:.1f}%", "start" if tx >= 220 else "end")
        turn += share
    return _svg(title, 560, 380, body)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))
