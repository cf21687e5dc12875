"""The six reliability rules as one pass over cues: doc_id, seq, cue_no, start_ms, end_ms, text.

Neighbours are those in file order, so one window by doc_id is all the shuffle that there is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions import metrics as m
from cuewright.functions.timecode import format_srt_time
from cuewright.operators.places import with_neighbours

#: Names of rules and severities, and the texts of findings; fixed values.
RULES = ["okuma_hizi", "asgari_dinlenme", "satir_uzunlugu", "cakisan_araliklar", "sira_bozuklugu", "kodlama_bozuklugu"]
WARNING, CRITICAL = "uyari", "kritik"

FINDING = "struct<rule:string,severity:string,cue_no:bigint,related_cue_no:bigint,line:int,measured:string,threshold:string,message:string,suggestion:string>"
COLUMNS = ["rule", "severity", "cue_no", "related_cue_no", "line", "measured", "threshold", "message", "suggestion"]


@dataclass(frozen=True)
class Thresholds:
    okuma_hizi: float = 17.0
    asgari_dinlenme_ms: int = 1000
    asgari_hiz: float = 6.0
    en_fazla_karakter: int = 42
    en_fazla_satir: int = 2
    kabul_edilebilir_bosluk_ms: int = 0


KINDS = {"okuma_hizi": "double", "asgari_dinlenme_ms": "bigint", "asgari_hiz": "double", "en_fazla_karakter": "int", "en_fazla_satir": "int", "kabul_edilebilir_bosluk_ms": "bigint"}


def limits(t: Thresholds | None = None, profile: str | None = None) -> dict[str, Column]:
    """Thresholds as columns: literals, or fields of a struct column with defaults for what is missing."""
    base = {k: F.lit(v).cast(KINDS[k]) for k, v in vars(t or Thresholds()).items()}
    return {k: F.coalesce(F.col(f"{profile}.{k}").cast(KINDS[k]), v) for k, v in base.items()} if profile else base


def found(rule: str, severity: str, measured: Column, threshold: Column, message: Column, suggestion: str, line=0, related=None, cue="cue_no") -> Column:
    values = [F.lit(rule), F.lit(severity), F.lit(None) if cue is None else F.col(cue), F.lit(None) if related is None else related, F.lit(line) if isinstance(line, int) else line, measured, threshold, message, F.lit(suggestion)]
    return F.struct(*(v.alias(c) for v, c in zip(values, COLUMNS, strict=True))).cast(FINDING)


def text(template: str, *values) -> Column:
    return F.format_string(template, *values)


def neighbour() -> Column:
    """What rules need of the cue before and after."""
    return F.struct("cue_no", "start_ms", "end_ms")


def cue_findings(t: dict[str, Column]) -> Column:
    """The findings of rules 1 to 5 of a cue with its neighbours, as an array."""
    n, span, chars, speed = F.col("cue_no"), m.duration(), m.characters(), m.reading_speed()
    need = m.required_ms(t["asgari_dinlenme_ms"], t["asgari_hiz"])
    rows = m.lines()
    shown, top = m.one_decimal(speed), m.one_decimal(t["okuma_hizi"])
    out = [
        F.when((span > 0) & (speed > t["okuma_hizi"]), found(RULES[0], WARNING, text("%s karakter/sn", shown), text("%s karakter/sn", top), text("replik %d icinde %s karakter/saniye okunuyor", n, shown), "sureyi uzat veya repligi ikiye bol")),
        F.when((span >= 0) & (span < need), found(RULES[1], WARNING, text("%d ms (%d karakter)", span, chars), text("%d ms", need), text("replik %d yalnizca %d ms kaliyor, %d karakter icin gereken %d ms", n, span, chars, need), "sureyi gereken degere yukselt")),
    ]
    long_lines = F.filter(
        F.transform(rows, lambda x, i: F.when(F.length(x) > t["en_fazla_karakter"], found(RULES[2], WARNING, text("%d karakter", F.length(x)), text("%d karakter", t["en_fazla_karakter"]), text("replik %d satir %d cok uzun (%d karakter)", n, i + 1, F.length(x)), "satiri bol veya yeniden sar", i + 1))),
        lambda x: x.isNotNull(),
    )
    many = F.when(F.size(rows) > t["en_fazla_satir"], found(RULES[2], WARNING, text("%d satir", F.size(rows)), text("%d satir", t["en_fazla_satir"]), text("replik %d'da %d satir var, okunabilir en fazla %d satir olabilir", n, F.size(rows), t["en_fazla_satir"]), "satirlari birlestir veya repligi ikiye bol"))
    gap, after = F.col("end_ms") - F.col("after.start_ms"), F.col("after.cue_no")
    valid = m.timing_valid() & (F.col("after.end_ms") >= F.col("after.start_ms"))
    rest = [
        F.when(valid & (gap > t["kabul_edilebilir_bosluk_ms"]), found(RULES[3], CRITICAL, text("%d ms cakisma", gap), text("> %d ms", t["kabul_edilebilir_bosluk_ms"]), text("replik %d ve %d ayni anda ekranda gorunebiliyor (%d ms)", n, after, gap), "sonraki repligi oncekinin bitisine kaydir", related=after)),
        F.when(span < 0, found(RULES[4], CRITICAL, text("%d ms", span), F.lit("0 ms"), text("replik %d'da bitis baslangictan once (%d ms negatif sure)", n, span), "bitis zamanini baslangictan sonra tasi")),
        F.when(span == 0, found(RULES[4], CRITICAL, F.lit("0 ms"), F.lit("> 0 ms"), text("replik %d'da baslangic ve bitis ayni", n), "bitis zamanini ilerlet")),
        F.when(F.col("start_ms") < F.col("before.start_ms"), found(RULES[4], CRITICAL, F.concat(format_srt_time("start_ms"), F.lit(" < "), format_srt_time("before.start_ms")), F.lit("baslangic artan sirada"), text("replik %d onceki replik %d'den once basliyor; dosya sirasi bozuk", n, F.col("before.cue_no")), "normalize --sirala ile siralamayi duzelt")),
    ]
    return F.concat(F.array_compact(F.array(*out)), long_lines, F.array_compact(F.array(many, *rest)))


def encoding_findings(e: str = "encoding") -> Column:
    """The findings of rule 6 of a document with an encoding report, as an array."""
    c = lambda x: F.col(f"{e}.{x}")
    make = lambda *a: found(RULES[5], *a, cue=None)
    return F.array_compact(
        F.array(
            F.when(c("has_bom"), make(WARNING, text("%s (BOM)", c("encoding")), F.lit("BOM'suz UTF-8"), F.lit("dosya bayt sirasi isareti (BOM) ile basliyor; bazi oynaticilar ilk satiri bos sayar"), "dosyayi BOM'suz UTF-8 olarak yeniden yaz")),
            F.when(c("mixed"), make(CRITICAL, text("%d tek bayt satir", c("single_byte_lines")), F.lit("tek kodlama"), F.lit("dosyada hem UTF-8 hem tek bayt satirlar var; kodlama karisik"), "dosyayi tek kodlamaya (UTF-8) cevir")),
            F.when(c("bad_seq") > 0, make(CRITICAL, text("%d bozuk bayt dizisi", c("bad_seq")), F.lit("0"), F.lit("dosyada UTF-8 olarak cozulemeyen bayt dizileri var"), "dosyayi yeniden kodla")),
            F.when((c("fffd") > 0) & ~c("mixed"), make(WARNING, text("%d U+FFFD", c("fffd")), F.lit("0"), F.lit("kaynakta degistirme isareti (U+FFFD) var; karakterler kaybolmus olabilir"), "kaynak dosyayi kontrol et")),
        )
    )


def check(cues: DataFrame, thresholds: Thresholds | None = None, profiles: DataFrame | None = None, documents: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """findings of cues (rules 1-5, with a profile by doc_id where there is one) and of documents (rule 6). chunk: for documents
    of any length, as in with_neighbours()."""
    rows, profile = with_neighbours(cues, neighbour(), chunk), None
    if profiles is not None:
        own = profiles.select("doc_id", F.struct(*(c for c in profiles.columns if c in KINDS)).alias("profile"))
        rows, profile = rows.join(own, "doc_id", "left"), "profile"
    if profile:
        absent = [k for k in KINDS if k not in profiles.columns]
        rows = rows.withColumn("profile", F.struct(*(F.lit(None).cast(KINDS[k]).alias(k) if k in absent else F.col(f"profile.{k}").alias(k) for k in KINDS)))
    out = rows.select("doc_id", "seq", F.explode(cue_findings(limits(thresholds, profile))).alias("f")).select("doc_id", "seq", "f.*")
    if documents is not None:
        own = documents.select("doc_id", F.lit(None).cast("bigint").alias("seq"), F.explode(encoding_findings()).alias("f"))
        out = out.unionByName(own.select("doc_id", "seq", "f.*"))
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """findings with their place in the document's report."""
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("cue_no", F.lit(0)), "line", order, "message")
    return findings.withColumn("rank", F.row_number().over(w).cast("bigint"))
