"""Character encodings of file contents (BINARY): text, and an audit that never rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = "struct<encoding:string,has_bom:boolean,bad_seq:bigint,fffd:bigint,mixed:boolean,single_byte_lines:bigint,notes:array<string>>"

#: Bytes 80-9F and the seven others in which single-byte Turkish differs from Latin-1, and what they mean; fixed values.
#: FFFD stands for bytes without a meaning.
SINGLE_BYTE = {
    0x80: 0x20AC, 0x81: 0xFFFD, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8D: 0xFFFD, 0x8E: 0xFFFD, 0x8F: 0xFFFD,
    0x90: 0xFFFD, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9D: 0xFFFD, 0x9E: 0x017E, 0x9F: 0x0178,
    0xD0: 0x011E, 0xDD: 0x0130, 0xDE: 0x015E, 0xF0: 0x011F, 0xFD: 0x0131, 0xFE: 0x015F, 0xFF: 0x0178,
}
#: Names of encodings and notes; fixed values.
UTF8, UTF8_BOM, LE, BE, SINGLE, MIXED = "utf-8", "utf-8-bom", "utf-16-le", "utf-16-be", "windows-1254", "karisik"


#: UTF-16 bytes as Latin-1 characters: well-formed units (group 1), then a first surrogate without a second or a second without
#: a first. The runs are possessive, so Java walks them in a loop, whatever their length.
LONE = {BE: r"(?s)\G((?:[^Ø-ß].|[Ø-Û].[Ü-ß].)*+)[Ø-ß].", LE: r"(?s)\G((?:.[^Ø-ß]|.[Ø-Û].[Ü-ß])*+).[Ø-ß]"}

#: U+FFFD in such characters; Spark's names.
MARK, CHARSET = {BE: "ÿý", LE: "ýÿ"}, {BE: "UTF-16BE", LE: "UTF-16LE"}


def once(x: Column, of) -> Column:
    """of(x) with x computed once, however often it is used there."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def utf16(body: Column, big: Column) -> Column:
    """UTF-16 bytes as a struct: text, with lone surrogates as U+FFFD; bad, how many units were bad, a last odd byte among them;
    fffd, the text's replacement marks. Spark's decoder raises on lone surrogates, so they are repaired first."""
    pick = lambda of: F.when(big, of(BE)).otherwise(of(LE))
    even = F.substring(body, F.lit(1), F.length(body) - F.length(body) % 2)
    # A lone surrogate's two bytes become one character that no byte is, so lengths tell how many there are.
    marked = pick(lambda e: F.regexp_replace(latin(even), LONE[e], "$1�"))

    def read(m: Column) -> Column:
        lone = F.length(even) - F.length(m)
        whole = F.when(lone == 0, even).otherwise(F.encode(F.replace(m, F.lit("�"), pick(lambda e: F.lit(MARK[e]))), "ISO-8859-1"))
        text = pick(lambda e: F.decode(whole, CHARSET[e]))
        bad = (lone + F.length(body) % 2).cast("bigint")
        return once(text, lambda t: F.struct(t.alias("text"), bad.alias("bad"), times(t, "�").alias("fffd")))

    return once(marked, read)


def bom(content) -> tuple[Column, Column, Column]:
    """(encoding by byte order mark or null, its length, note or null)."""
    start = F.hex(F.substring(F.col(content), 1, 4))
    first = F.when(start.startswith("EFBBBF"), 1).when(start == "FFFE0000", 2).when(start.startswith("FFFE"), 3).when(start.startswith("FEFF"), 4)
    pick = lambda *values: F.when(first == 1, values[0]).when(first == 2, values[1]).when(first == 3, values[2]).when(first == 4, values[3])
    note = pick("dosya UTF-8 BOM ile basliyor", "dosya UTF-32 LE BOM ile basliyor; UTF-16 olarak ele alindi", "dosya UTF-16 LE BOM ile basliyor", "dosya UTF-16 BE BOM ile basliyor")
    return pick(UTF8_BOM, LE, LE, BE), F.coalesce(pick(3, 2, 2, 2), F.lit(0)), note


def latin(x: Column) -> Column:
    return F.decode(x, "ISO-8859-1")


def single_byte(x: Column) -> Column:
    """Bytes as single-byte Turkish text."""
    return F.translate(latin(x), "".join(map(chr, SINGLE_BYTE)), "".join(map(chr, SINGLE_BYTE.values())))


def times(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("bigint")


def bad_sequences(x: Column) -> Column:
    """Ill-formed UTF-8 sequences (maximal parts) in bytes: replacement marks made, less those that were there."""
    text = F.call_function("make_valid_utf8", x.cast("string"))
    return times(text, "�") - times(latin(x), "ï¿½")


def line_kinds(x: Column) -> tuple[Column, Column]:
    """(well-formed UTF-8 lines, other lines) among the lines with a byte over 7F."""
    lines = F.transform(F.split(latin(x), "\n"), lambda s: F.regexp_replace(s, "\r$", ""))
    high = F.filter(lines, lambda s: s.rlike("[\\x80-\\xff]"))
    valid = F.size(F.filter(high, lambda s: F.call_function("is_valid_utf8", F.encode(s, "ISO-8859-1").cast("string")))).cast("bigint")
    return valid, F.size(high).cast("bigint") - valid


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text and encoding (the report) added, by column functions alone."""
    mark, length, note = bom(content)
    rows = files.withColumn("_mark", mark).withColumn("_body", F.expr(f"substring({content}, 1 + CASE WHEN hex(substring({content}, 1, 3)) = 'EFBBBF' THEN 3 WHEN hex(substring({content}, 1, 2)) IN ('FFFE', 'FEFF') THEN 2 ELSE 0 END)")).withColumn("_note", note)
    wide = F.col("_mark").isin(LE, BE)
    body, zero = F.col("_body"), F.lit(0).cast("bigint")
    valid = F.call_function("is_valid_utf8", body.cast("string"))
    good, other = line_kinds(body)
    mixed = ~valid & (good > 0) & (other > 0)
    plain = F.when(valid, body.cast("string")).otherwise(single_byte(body))
    bad = F.when(valid, zero).otherwise(bad_sequences(body))
    lost = F.when(valid, times(plain, "�")).otherwise(times(single_byte(body), "�"))
    remark = F.when(mixed, F.format_string("dosya karisik kodlama: %d satir UTF-8, %d satir tek bayt", good, other)).when(~valid, F.format_string("dosya UTF-8 degil; windows-1254 (Turkce tek bayt) olarak cozuldu, %d bayt dizisi bozuk", bad)).when(lost > 0, "kaynak metinde U+FFFD degistirme isareti var; kodlama kaybi olmus")
    name = F.when(mixed, MIXED).when(~valid, SINGLE).otherwise(F.coalesce("_mark", F.lit(UTF8)))
    report = F.struct(name.alias("encoding"), F.col("_mark").isNotNull().alias("has_bom"), bad.alias("bad_seq"), lost.alias("fffd"), mixed.alias("mixed"), F.when(valid, zero).otherwise(other).alias("single_byte_lines"), F.array_compact(F.array("_note", remark)).alias("notes"))
    wide = F.coalesce(wide, F.lit(False))

    def units(x: Column) -> Column:
        other = F.struct(F.col("_mark").alias("encoding"), F.lit(True).alias("has_bom"), x["bad"].alias("bad_seq"), x["fffd"].alias("fffd"), F.lit(False).alias("mixed"), zero.alias("single_byte_lines"), F.array("_note").alias("notes"))
        return F.struct(x["text"].alias("text"), other.cast(REPORT).alias("encoding"))

    own = once(utf16(body, F.col("_mark") == BE), units)
    found = F.when(wide, own).otherwise(F.struct(plain.alias("text"), report.cast(REPORT).alias("encoding")))
    # Exploding one element keeps the optimizer from copying these long expressions to each place that reads the text.
    return rows.select(*files.columns, F.explode(F.array(found)).alias("_f")).select(*files.columns, "_f.*")


def healthy(e: str = "encoding") -> Column:
    """No mark, no bad sequence, no replacement mark, not mixed."""
    return ~F.col(f"{e}.has_bom") & (F.col(f"{e}.bad_seq") == 0) & (F.col(f"{e}.fffd") == 0) & ~F.col(f"{e}.mixed")
