"""Exports: CSV lines, spreadsheet and slide packages, draw lists."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinwall.functions import color as C
from pinwall.functions import text as T

# The header of board tables.
HEADER = ("Post-it-Nr.", "Reihe/Zeile", "Spalte", "Farbe", "Farbcode (HEX)", "Text")
SLIDE_WIDTH, SLIDE_HEIGHT, MARGIN = 13.333, 7.5, 0.34
BOM = "﻿"


def csv_cell(value: Column) -> Column:
    """Quoted text; null is an empty cell; what a spreadsheet would run as a formula gets an apostrophe."""
    text = value.cast("string")
    text = F.when(text.rlike(r"^[=+@\-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def csv_lines(rows: DataFrame) -> DataFrame:
    """board_id, number, line of spreadsheet rows."""
    cells = [csv_cell(F.col(c)) for c in ("number", "row", "column", "color", "color_hex", "text")]
    return rows.select("board_id", "number", F.concat_ws(";", *cells).alias("line"))


def csv_documents(rows: DataFrame) -> DataFrame:
    """board_id, csv: the whole file of each board, with byte order mark, header and CRLF."""
    head = ";".join(f'"{h}"' for h in HEADER)
    lines = csv_lines(rows).groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("l"))
    return lines.select("board_id", F.concat(F.lit(BOM + head + "\r\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")).alias("csv"))


def board_bounds(aspect: float) -> tuple[float, float, float, float]:
    """x, y, width, height of the board on the slide, in inches."""
    aspect = min(3.2, max(0.45, aspect or 1.6))
    room_w, room_h = SLIDE_WIDTH - 2 * MARGIN, SLIDE_HEIGHT - 2 * MARGIN
    w, h = (room_w, room_w / aspect) if aspect >= room_w / room_h else (room_h * aspect, room_h)
    return (SLIDE_WIDTH - w) / 2, (SLIDE_HEIGHT - h) / 2, w, h


def font_size(text: Column, width: Column, height: Column) -> Column:
    letters = F.greatest(F.lit(4), F.length(F.trim(text)))
    fit = F.sqrt(F.greatest(F.lit(0.02), width * height) / letters) * 34
    return T.clamp(T.js_round(F.least(fit, height * 22) * 10) / 10, 8.0, 22.0)


def slide_shapes(notes: DataFrame, edges: DataFrame, aspect: float = 1.6) -> DataFrame:
    """What is drawn on each board's slide, in inches: the board, then edges whose notes exist, then notes by z_index."""
    bx, by, bw, bh = board_bounds(aspect)
    n = notes.select(
        "board_id",
        "note_id",
        F.lit("note").alias("kind"),
        F.lit(2).alias("layer"),
        F.coalesce("z_index", F.lit(0)).cast("long").alias("z"),
        (F.lit(bx) + F.col("x") / 100 * bw).alias("x"),
        (F.lit(by) + F.col("y") / 100 * bh).alias("y"),
        F.greatest(F.lit(0.08), F.col("width") / 100 * bw).alias("w"),
        F.greatest(F.lit(0.08), F.col("height") / 100 * bh).alias("h"),
        T.clamp(F.coalesce("rotation", F.lit(0.0)), -360.0, 360.0).alias("rotation"),
        C.clean_hex(F.col("color"), "F7DC68").alias("fill"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    n = n.withColumn("font_size", font_size(F.col("text"), F.col("w"), F.col("h")))
    c = notes.select("board_id", "note_id", (F.lit(bx) + (F.col("x") + F.col("width") / 2) / 100 * bw).alias("cx"), (F.lit(by) + (F.col("y") + F.col("height") / 2) / 100 * bh).alias("cy"))
    s = c.select("board_id", F.col("note_id").alias("source_id"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    t = c.select("board_id", F.col("note_id").alias("target_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    e = edges.join(s, ["board_id", "source_id"]).join(t, ["board_id", "target_id"])
    null = F.lit(None)
    e = e.select("board_id", F.col("source_id").alias("note_id"), F.lit("edge").alias("kind"), F.lit(1).alias("layer"), F.col("target_id").cast("long").alias("z"), F.col("sx").alias("x"), F.col("sy").alias("y"), (F.col("tx") - F.col("sx")).alias("w"), (F.col("ty") - F.col("sy")).alias("h"), F.lit(0.0).alias("rotation"), F.lit("56544D").alias("fill"), null.cast("string").alias("text"), null.cast("double").alias("font_size"))
    b = notes.select("board_id").distinct().select("board_id", null.cast("long").alias("note_id"), F.lit("board").alias("kind"), F.lit(0).alias("layer"), F.lit(0).cast("long").alias("z"), F.lit(bx).alias("x"), F.lit(by).alias("y"), F.lit(bw).alias("w"), F.lit(bh).alias("h"), F.lit(0.0).alias("rotation"), F.lit("F7F4EC").alias("fill"), null.cast("string").alias("text"), null.cast("double").alias("font_size"))
    return b.unionByName(e).unionByName(n)


# ---------------------------------------------------------------- packages

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>%s</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
_REL = '<Relationship Id="rId%d" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/>'


def _package(parts: dict[str, str]) -> bytes:
    """A zip with fixed dates, so that equal boards give equal files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbook(rows: list[tuple], sheet: str = "Post-its") -> bytes:
    """XLSX with a frozen header, filter and coloured colour cells; rows are (number, row, column, color, color_hex, text)."""
    fills = sorted({r[4] for r in rows})
    solid = '<fill><patternFill patternType="solid"><fgColor rgb="FF%s"/></patternFill></fill>'
    styles = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<fonts count="3"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/></font><font><b/><sz val="11"/><color rgb="FF292923"/></font></fonts>'
        f'<fills count="{3 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid % "292923"}{"".join(solid % f[1:] for f in fills)}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{3 + len(fills)}"><xf/><xf fontId="1" fillId="2" applyFill="1"/><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf>'
        + "".join(f'<xf fontId="2" fillId="{3 + i}" applyFill="1" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf>' for i in range(len(fills)))
        + "</cellXfs></styleSheet>"
    )

    def cell(ref: str, value, style: int) -> str:
        if value is None:
            return f'<c r="{ref}" s="{style}"/>'
        if isinstance(value, int):
            return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
        return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = ["<row r=\"1\" ht=\"27\" customHeight=\"1\">" + "".join(cell(f"{c}1", h, 1) for c, h in zip("ABCDEF", HEADER)) + "</row>"]
    for i, r in enumerate(rows, 2):
        lines.append(f'<row r="{i}" ht="34" customHeight="1">' + "".join(cell(f"{c}{i}", v, 3 + fills.index(r[4]) if c == "D" else 2) for c, v in zip("ABCDEF", r)) + "</row>")
    widths = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate((14, 15, 12, 18, 19, 58), 1))
    sheet_xml = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{widths}</cols><sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:F1"/><pageSetup orientation="landscape" fitToHeight="0"/></worksheet>'
    )
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    over = "".join(f'<Override PartName="/xl/{p}" ContentType="{main}.{t}+xml"/>' for p, t in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("styles.xml", "styles")))
    book = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>'
    return _package({
        "[Content_Types].xml": _TYPES % over,
        "_rels/.rels": _RELS % (_REL % (1, "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": book,
        "xl/_rels/workbook.xml.rels": _RELS % (_REL % (1, "worksheet", "worksheets/sheet1.xml") + _REL % (2, "styles", "styles.xml")),
        "xl/worksheets/sheet1.xml": sheet_xml,
        "xl/styles.xml": styles,
    })


_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_GROUP = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'


def _emu(inches: float) -> int:
    return int(inches * 914400 + 0.5)


def _shape(i: int, s: dict) -> str:
    x, y, w, h = s["x"], s["y"], s["w"], s["h"]
    flip = (' flipH="1"' if w < 0 else "") + (' flipV="1"' if h < 0 else "")
    turn = f' rot="{int(s["rotation"] * 60000)}"' if s["rotation"] else ""
    place = f'<a:xfrm{turn}{flip}><a:off x="{_emu(min(x, x + w))}" y="{_emu(min(y, y + h))}"/><a:ext cx="{_emu(abs(w))}" cy="{_emu(abs(h))}"/></a:xfrm>'
    name = {"board": "Board", "edge": f"Connection {i}", "note": f"Note {i}"}[s["kind"]]
    if s["kind"] == "edge":
        line = f'<a:ln w="17780"><a:solidFill><a:srgbClr val="{s["fill"]}"/></a:solidFill><a:tailEnd type="triangle"/></a:ln>'
        return f'<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="{i + 1}" name="{name}"/><p:cNvCxnSpPr/><p:nvPr/></p:nvCxnSpPr><p:spPr>{place}<a:prstGeom prst="line"><a:avLst/></a:prstGeom>{line}</p:spPr></p:cxnSp>'
    size = int((s["font_size"] or 12) * 100)
    lines = "".join(f'<a:p><a:r><a:rPr lang="de-DE" sz="{size}" b="1"><a:solidFill><a:srgbClr val="292923"/></a:solidFill></a:rPr><a:t>{escape(t)}</a:t></a:r></a:p>' for t in (s["text"] or "").split("\n"))
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i + 1}" name="{name}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{place}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:solidFill><a:srgbClr val="{s["fill"]}"/></a:solidFill></p:spPr><p:txBody><a:bodyPr anchor="t"><a:normAutofit/></a:bodyPr><a:lstStyle/>{lines}</p:txBody></p:sp>'


def presentation(shapes: list[dict]) -> bytes:
    """PPTX of one slide with editable shapes, drawn by layer, z and id."""
    drawn = sorted(shapes, key=lambda s: (s["layer"], s["z"], s["note_id"] or 0))
    tree = "".join(_shape(i, s) for i, s in enumerate(drawn, 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    slide = f'{head}<p:sld {_A}><p:cSld><p:bg><p:bgPr><a:solidFill><a:srgbClr val="ECE9E1"/></a:solidFill><a:effectLst/></p:bgPr></p:bg><p:spTree>{_GROUP}{tree}</p:spTree></p:cSld></p:sld>'
    master = f'{head}<p:sldMaster {_A}><p:cSld><p:spTree>{_GROUP}</p:spTree></p:cSld><p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'
    layout = f'{head}<p:sldLayout {_A}><p:cSld><p:spTree>{_GROUP}</p:spTree></p:cSld></p:sldLayout>'
    colors = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in (("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "292923"), ("lt2", "ECE9E1"), *((f"accent{i}", "F7DC68") for i in range(1, 7)), ("hlink", "0000FF"), ("folHlink", "800080")))
    font = '<a:latin typeface="Aptos"/><a:ea typeface=""/><a:cs typeface=""/>'
    plain = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    theme = f'{head}<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="Board"><a:themeElements><a:clrScheme name="Board">{colors}</a:clrScheme><a:fontScheme name="Board"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="Board"><a:fillStyleLst>{plain * 3}</a:fillStyleLst><a:lnStyleLst>{("<a:ln>" + plain + "</a:ln>") * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{plain * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    pres = f'{head}<p:presentation {_A}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst><p:sldId id="256" r:id="rId2"/></p:sldIdLst><p:sldSz cx="{_emu(SLIDE_WIDTH)}" cy="{_emu(SLIDE_HEIGHT)}"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'
    kind = "application/vnd.openxmlformats-officedocument"
    over = "".join(f'<Override PartName="/ppt/{p}" ContentType="{kind}.{t}+xml"/>' for p, t in (("presentation.xml", "presentationml.presentation.main"), ("slides/slide1.xml", "presentationml.slide"), ("slideMasters/slideMaster1.xml", "presentationml.slideMaster"), ("slideLayouts/slideLayout1.xml", "presentationml.slideLayout"), ("theme/theme1.xml", "theme")))
    return _package({
        "[Content_Types].xml": _TYPES % over,
        "_rels/.rels": _RELS % (_REL % (1, "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": pres,
        "ppt/_rels/presentation.xml.rels": _RELS % (_REL % (1, "slideMaster", "slideMasters/slideMaster1.xml") + _REL % (2, "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": _RELS % (_REL % (1, "slideLayout", "../slideLayouts/slideLayout1.xml")),
        "ppt/slideMasters/slideMaster1.xml": master,
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _RELS % (_REL % (1, "slideLayout", "../slideLayouts/slideLayout1.xml") + _REL % (2, "theme", "../theme/theme1.xml")),
        "ppt/slideLayouts/slideLayout1.xml": layout,
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _RELS % (_REL % (1, "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/theme/theme1.xml": theme,
    })


def workbooks(rows: DataFrame) -> DataFrame:
    """board_id, xlsx: a file for each board, built in a task of its own."""
    import pandas as pd

    def build(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("number")
        plain = [tuple(None if pd.isna(v) else int(v) if i < 3 else v for i, v in enumerate(r)) for r in g[["number", "row", "column", "color", "color_hex", "text"]].itertuples(index=False)]
        return pd.DataFrame({"board_id": [key[0]], "xlsx": [workbook(plain)]})

    return rows.groupBy("board_id").applyInPandas(build, "board_id long, xlsx binary")


def presentations(shapes: DataFrame) -> DataFrame:
    """board_id, pptx: a file for each board."""
    import pandas as pd

    def build(key, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"board_id": [key[0]], "pptx": [presentation(g.astype(object).where(g.notna(), None).to_dict("records"))]})

    return shapes.groupBy("board_id").applyInPandas(build, "board_id long, pptx binary")
