"""One scan of raw texts of all formats: every document, cue, style, header and syntax error from the same rows.

A text's lines are exploded once and exchanged once. What a line means depends on lines before it only through running
values (the last blank line, the last arrow, the last section head, counts), so all of it is running aggregates over one
order, (document, line), and positions are running counts. One aggregation by run of lines then joins a cue's text, and its
rows are tagged with their kind.

For documents of any length the same windows run over chunks of lines. A chunk's summary says, for each state in which it
may begin, the state in which it ends and what it adds to the counts; summaries compose, so a fold over a document's
summaries (a row for each chunk) gives each chunk its first state. No task then holds a whole document's lines.

SRT. In a run of non-blank lines the first line with an arrow is the cue's time line and what follows is its text. Before
it, a line with a number opens a block and takes the next line as its time line, so of consecutive numbers every other one
opens a block. Cues without a number are numbered on from the highest number so far, counting each block opened without
one.

WebVTT. After the WEBVTT line, header lines go on to the first that isn't `key: value`. In each run of non-blank lines after
that, the first decisive line counts: NOTE, STYLE or REGION take the rest of the run; an arrow, or a line before an arrow
(a cue's name), makes a cue. Lines before it are errors.

ASS. A line's section is that of the last line with `[`. The first Format line after a section's head sets the columns of
that kind, until another sets them; Format lines outside the known sections set them too.
"""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.metrics import event_kind, fold
from cuewright.functions.timecode import parse_timestamp, strip
from cuewright.operators.defaults import EVENT_FORMAT, STYLE_FORMAT
from cuewright.sources.lines import ARROW, clean, physical_lines, time_line

FORMATS = ("srt", "vtt", "ass")
LONG = "bigint"
PAIRS = "array<struct<name:string,value:string>>"
CUE = "struct<seq:bigint,cue_no:bigint,start_ms:bigint,end_ms:bigint,text:string,style:string,speaker:string,margin_l:int,margin_r:int,margin_v:int,effect:string,layer:int,event_kind:string>"
STYLE = f"struct<style_pos:int,name:string,fields:{PAIRS}>"
ERROR = "struct<format:string,line:int,message:string>"
#: Where a chunk may begin. SRT: in a run before its arrow, there after a number that takes the next line, after the arrow.
#: WebVTT: in the header, in a run of which nothing is decided, in one that is decided, in one of style rules.
FRESH, TAKING, TEXT = 0, 1, 2
HEADER, OPEN, DECIDED, RULES = 0, 1, 2, 3
STATE = "struct<hyp:int,value:bigint,inc:bigint,lead:bigint,cues:bigint,heads:bigint,blank:int,first:struct<ln:int,kind:string>>"


def wrong(when: Column, line: Column, message: Column) -> Column:
    return F.when(when, F.struct(line.cast("int").alias("line"), message.alias("message")))


def after_colon(x: str) -> Column:
    return F.substring(F.col(x), F.instr(x, ":") + 1, F.length(x))


def whole(x: Column, kind: str = "int") -> Column:
    return F.coalesce(F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast(kind)), F.lit(0).cast(kind))


class Scan:
    """The columns of a line in a scan of some formats. by: the window's keys; chunks have start (a STATE) and base (their
    first line)."""

    def __init__(self, formats: tuple[str, ...], by: tuple[str, ...] = ("doc_id",), chunked: bool = False):
        self.formats, self.chunked = formats, chunked
        w = Window.partitionBy(*by).orderBy("ln")
        self.w, self.upto, self.prior = w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)

    def is_(self, f: str) -> Column:
        return F.lit(self.formats == (f,)) if f not in self.formats or len(self.formats) == 1 else F.col("format") == f

    def start(self, field: str, default) -> Column:
        return F.col(f"start.{field}") if self.chunked else default

    def last(self, when: Column, w=None) -> Column:
        """The last line so far (or of those before, with w) where something holds; null if there is none."""
        return F.max(F.when(when, F.col("ln"))).over(w or self.upto)

    def count(self, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, 1).otherwise(0).cast(LONG)).over(self.upto), F.lit(0).cast(LONG))

    # Each of these gives the columns level by level: those of a level need only the levels before it.

    def lines(self) -> list[dict[str, Column]]:
        """l (cleaned), body (it is a line, not the document's own row), blank, fresh (no blank line in this chunk yet) and run
        (the last blank line)."""
        col, no = F.col, F.lit(False)
        return [
            {"l": clean("raw"), "body": col("ln") >= 0},
            {"blank": F.coalesce(col("l") == "", no), "has_arrow": F.coalesce(col("l").contains(ARROW), no)},
            {"own_blank": self.last(col("blank"))},
            {"run": F.coalesce("own_blank", self.start("blank", F.lit(-1))), "fresh": col("own_blank").isNull()},
        ]

    def srt(self) -> list[dict[str, Column]]:
        """s_opens (the line's number opens a block), s_takes (the line before announced it, with the number s_given), s_start
        (it opens a block without a number), s_at (it is a cue's time line), s_text, s_no (the cue's number), s_seq."""
        col, own, none, zero = F.col, self.is_("srt") & F.col("body"), F.lit(None).cast(LONG), F.lit(0).cast(LONG)
        base = col("base") if self.chunked else F.lit(0)
        begins, hyp = col("ln") == base, self.start("hyp", F.lit(FRESH))
        seen = F.coalesce(self.last(own & col("has_arrow"), self.prior) > col("run"), F.lit(False)) | (col("fresh") & (hyp == TEXT))
        value = F.when(own & col("l").rlike(r"^\+?[0-9]+$"), col("l").try_cast("decimal(38,0)"))
        # Numbers in a row since the last other line; a chunk may begin after the first of them.
        since = F.when(col("s_other").isNull(), col("ln") - base + 1 + (hyp == TAKING).cast("int")).otherwise(col("ln") - col("s_other"))
        takes = own & F.coalesce(F.when(begins, hyp == TAKING).otherwise(F.lag("s_opens").over(self.w)), F.lit(False))
        given = F.when(begins, self.start("value", none)).otherwise(F.lag("s_value").over(self.w))
        lead = F.greatest(self.start("lead", zero), F.coalesce(F.max("s_lead").over(self.prior), zero))
        return [
            {"s_text": own & ~col("blank") & seen, "s_before": own & ~col("blank") & ~seen},
            {"s_value": F.when(col("s_before") & (value <= 4294967295), value.cast(LONG)), "s_at": col("s_before") & col("has_arrow")},
            {"s_other": self.last(own & col("s_value").isNull())},
            {"s_opens": col("s_value").isNotNull() & (since % 2 == 1)},
            {"s_takes": takes, "s_given": F.when(takes, given)},
            {"s_start": col("s_before") & ~col("s_opens") & ~col("s_takes"), "s_number": F.when(col("s_at") & col("s_given").isNotNull(), F.greatest("s_given", F.lit(1)))},
            {"s_inc": self.count(col("s_start")) + self.start("inc", zero)},
            {"s_lead": col("s_number") - col("s_inc")},
            {"s_no": F.coalesce("s_number", col("s_inc") + lead), "s_seq": self.count(col("s_at")) + self.start("cues", zero) - 1},
        ]

    def vtt(self) -> list[dict[str, Column]]:
        """v_header, v_live, v_first (the run's decisive line), v_decided, v_at (a cue's time line), v_text, v_seq, v_head (the
        line gives a header or a style rule), v_pos."""
        col, own, zero, no = F.col, self.is_("vtt") & F.col("body"), F.lit(0).cast(LONG), F.lit(False)
        hyp, starts = self.start("hyp", F.lit(HEADER)), lambda x: F.coalesce(F.col("l").startswith(x), F.lit(False))
        key = F.substring_index("l", ":", 1)
        pair = ~col("blank") & ~col("has_arrow") & ~starts("NOTE") & ~starts("STYLE") & col("l").contains(":") & (key != "") & ~key.contains(" ")
        fits = F.when(own, F.when(col("titled") & (col("ln") == 0), True).otherwise(pair))
        header = own & (hyp == HEADER) & (F.min(fits.cast("int")).over(self.upto) == 1)
        kind = F.when(starts("NOTE"), "note").when(starts("STYLE"), "style").when(starts("REGION"), "region").when(col("has_arrow"), "arrow").when(col("arrow_next"), "name")
        known = F.coalesce(self.last(col("v_kind").isNotNull(), self.prior) > col("run"), no) | (col("fresh") & (hyp >= DECIDED))
        first = F.last(F.when(col("v_leads"), F.struct("ln", col("v_kind").alias("kind"))), ignorenulls=True).over(self.upto)
        decided = own & (F.coalesce(col("v_first.ln") > col("run"), no) | (col("fresh") & (hyp >= DECIDED)))
        at = F.when(col("v_first.kind").isin("arrow", "name"), col("v_first.ln") + (col("v_first.kind") == "name").cast("int"))
        good = col("v_live") & col("v_decided")
        # In a summary it isn't known what decided the run before the chunk, but whether it is one of style rules.
        ruled = good & F.coalesce(col("v_first.kind") == "style", hyp == RULES) & (col("ln") > F.coalesce("v_first.ln", F.lit(-1))) & col("l").contains(":")
        return [
            {"v_header": header, "v_live": own & ~col("blank") & ~header},
            {"v_kind": F.when(col("v_live"), kind)},
            {"v_leads": col("v_kind").isNotNull() & ~known},
            {"v_first": F.coalesce(first, self.start("first", F.lit(None).cast("struct<ln:int,kind:string>")))},
            {"v_decided": decided},
            {"v_at": F.coalesce(good & (col("ln") == at), no), "v_text": F.coalesce(good & (col("ln") > at), no), "v_rule": ruled, "v_head": (col("v_header") & ((col("ln") > 0) | ~col("titled"))) | ruled},
            {"v_seq": self.count(col("v_leads") & col("v_kind").isin("arrow", "name")) + self.start("cues", zero) - 1, "v_pos": self.count(col("v_head")) + self.start("heads", zero) - 1},
        ]

    def ass(self) -> list[dict[str, Column]]:
        """a_section, a_line (neither head nor format), event_format and style_format, event_keys (the former folded), parts, and
        a_event, a_look and a_info (the line is an event, a style, a header) with their positions."""
        col, live = F.col, self.is_("ass") & F.col("body") & ~F.col("blank") & ~F.col("l").startswith(";")
        name = fold(strip(F.regexp_replace(F.substring(col("l"), 2, F.length("l")), r"\]+$", "")))
        section = F.when(name == "script info", "info").when(name.contains("styles"), "styles").when(name == "events", "events").otherwise("none")
        recent = lambda x: F.last(x, ignorenulls=True).over(self.upto)
        again = F.coalesce(self.last(col("a_format"), self.prior) > F.coalesce(self.last(col("a_head")), F.lit(-1)), F.lit(False))
        none, pair = col("a_section") == "none", col("l").contains(":")
        sets = col("a_format") & ((col("a_section").isin("styles", "events") & ~again) | none)
        for_events = (col("a_section") == "events") | (none & F.exists("a_columns", lambda c: fold(c) == "start"))
        default = lambda names: F.array(*map(F.lit, names))
        is_ = {"a_event": (col("a_section") == "events") & pair, "a_look": col("a_section") == "styles", "a_info": (col("a_section") == "info") & pair}
        return [
            {"a_live": live, "a_head": live & col("l").startswith("[")},
            {"a_section": F.coalesce(recent(F.when(col("a_head"), section)), F.lit("none")), "a_format": col("a_live") & ~col("a_head") & (col("l").startswith("Format:") | col("l").startswith("format:"))},
            {"a_sets": sets, "a_line": col("a_live") & ~col("a_head") & ~sets},
            {"a_columns": F.when(col("a_sets"), F.filter(F.transform(F.split(after_colon("l"), ","), strip), lambda x: x != "")), **{k: F.coalesce(col("a_line") & v, F.lit(False)) for k, v in is_.items()}},
            {"event_format": F.coalesce(recent(F.when(for_events, col("a_columns"))), default(EVENT_FORMAT)), "style_format": F.coalesce(recent(F.when(~for_events, col("a_columns"))), default(STYLE_FORMAT)), **{f"{k}_pos": self.count(col(k)) - 1 for k in is_}},
            {"event_keys": F.transform("event_format", fold), "parts": F.when(col("a_line"), F.split(F.when(pair, after_colon("l")).otherwise(col("l")), ",", -1))},
        ]

    def scanned(self, rows: DataFrame) -> DataFrame:
        for level in self.lines():
            rows = rows.withColumns(level)
        # All formats a level at a time: each call analyses the plan anew.
        for levels in zip_longest(*(getattr(self, f)() for f in self.formats), fillvalue={}):
            rows = rows.withColumns(reduce(dict.__or__, levels))
        return rows

    # What a scanned line gives

    def field(self, name: str) -> Column:
        at = F.array_position("event_keys", name).cast("int")
        return F.coalesce(F.when(at > 0, strip(F.get(F.col("parts"), at - 1))), F.lit(""))

    def event(self) -> Column:
        at, some, n = F.array_position("event_keys", "text").cast("int"), lambda x: F.when(x != "", x), F.lit(0).cast(LONG)
        text = F.when((at > 0) & (at <= F.size("parts")), clean(F.array_join(F.slice("parts", at, F.size("parts")), ","))).otherwise("")
        v = self.field
        return F.struct(
            F.col("a_event_pos"), F.col("a_event_pos") + 1, F.coalesce(parse_timestamp(v("start")), n), F.coalesce(parse_timestamp(v("end")), n), text,
            some(v("style")), some(v("name")), whole(v("marginl")), whole(v("marginr")), whole(v("marginv")), v("effect"), whole(v("layer")), event_kind(F.substring_index("l", ":", 1)),
        ).cast(CUE)

    def look(self) -> Column:
        parts = F.transform("parts", strip)
        pairs = F.zip_with("style_format", F.slice(parts, F.lit(1), F.size("style_format")), lambda k, v: F.struct(k.alias("name"), F.coalesce(v, F.lit("")).alias("value")))
        name = F.coalesce(F.get(F.filter(pairs, lambda f: fold(f["name"]) == "name"), F.lit(0))["value"], F.lit(""))
        return F.struct(F.col("a_look_pos").cast("int"), name, pairs).cast(STYLE)

    def wrongs(self) -> Column:
        """The errors of a line by itself."""
        col, line, out = F.col, F.col("ln") + 1, []
        text = F.lit
        if "srt" in self.formats:
            # A number before a blank line takes that line as its time line.
            out += [
                wrong(col("s_opens") & (line >= col("n")), line, text("numara satiri var ama zaman cizgisi yok")),
                wrong(col("s_given") == 0, line, text("replik numarasi 0 olamaz")),
                wrong((col("s_start") | col("s_takes")) & ~col("has_arrow"), line, F.concat(text("zaman cizgisinde '-->' ayraci yok: '"), "l", text("'"))),
            ]
        if "vtt" in self.formats:
            out += [
                wrong(self.is_("vtt") & ~col("body") & col("empty"), F.lit(0), text("dosya bos")),
                wrong(self.is_("vtt") & (col("ln") == 0) & ~col("titled"), line, F.concat(text("ilk satir 'WEBVTT' ile baslamiyor: '"), "l", text("'"))),
                wrong(col("v_live") & ~col("v_decided"), line, F.concat(text("zaman cizgisi bulunamadi: '"), "l", text("'"))),
            ]
        if "ass" in self.formats:
            n, look = F.size("parts"), col("a_look")
            unread = parse_timestamp(self.field("start")).isNull() | parse_timestamp(self.field("end")).isNull()
            own = [
                wrong(col("a_event") & (n < F.size("event_format")), line, F.format_string("olay satiri %d alan bekleniyordu, %d bulundu", F.size("event_format"), n)),
                wrong(col("a_event") & unread, line, F.concat(text("zaman damgasi okunamadi: '"), "l", text("'"))),
                wrong(look & (n < F.size("style_format")), line, F.format_string("stil satiri %d alan bekleniyordu, %d bulundu: '%s'", F.size("style_format"), n, "l")),
                wrong(col("a_line") & (col("a_section") == "info") & ~col("a_info"), line, F.concat(text("[Script Info] satirinda ':' ayraci yok: '"), "l", text("'"))),
                wrong(col("a_line") & (col("a_section") == "none"), line, F.concat(text("bolum basligi olmayan satir: '"), "l", text("'"))),
            ]
            out += own
        return F.array_compact(F.array(*out))

    def joined(self, rows: DataFrame) -> DataFrame:
        """One row for each run of lines, ASS line and document: what it gives, in one aggregation."""
        col, no = F.col, F.lit(False)
        either = lambda *x: [col(c) for c in x if {"s": "srt", "v": "vtt", "a": "ass"}[c[0]] in self.formats]
        pick = lambda *x: F.coalesce(*[F.when(when, then) for when, then in x]) if x else F.lit(None)
        any_ = lambda columns: reduce(lambda a, b: a | b, columns, no)
        at, after, head = any_(either("s_at", "v_at")), any_(either("s_text", "v_text")), any_(either("v_head", "a_info"))
        start, end, message = time_line()
        seq = pick(*[(col(f"{c}_at"), col(f"{c}_seq")) for c, f in (("s", "srt"), ("v", "vtt")) if f in self.formats] or [(no, F.lit(None).cast(LONG))])
        number = pick(*([(col("s_at"), col("s_no"))] if "srt" in self.formats else []), *([(col("v_at"), col("v_seq") + 1)] if "vtt" in self.formats else []) or [(no, F.lit(None).cast(LONG))])
        time = F.struct("ln", start.alias("start_ms"), end.alias("end_ms"), message.alias("wrong"), seq.alias("seq"), number.alias("cue_no"))
        position = pick(*([(col("v_head"), col("v_pos"))] if "vtt" in self.formats else []), *([(col("a_info"), col("a_info_pos"))] if "ass" in self.formats else []) or [(no, F.lit(None).cast(LONG))])
        name = strip(F.substring_index("l", ":", 1))
        name = F.when(col("v_rule"), F.concat(F.lit("STYLE "), name)).otherwise(name) if "vtt" in self.formats else name
        header = F.struct(position.cast("int").alias("pos"), name.alias("name"), strip(after_colon("l")).alias("value"))
        wrongs = self.wrongs()
        group = F.when(~col("body") | head, -2).when(self.is_("ass"), col("ln")).otherwise(col("run"))
        event, look = (F.when(col("a_event"), self.event()), F.when(col("a_look"), self.look())) if "ass" in self.formats else (F.lit(None).cast(CUE), F.lit(None).cast(STYLE))
        rows = rows.select("doc_id", "format", group.alias("part"), F.when(at, time).alias("t"), F.when(after, F.struct("ln", "raw")).alias("line"), F.when(head, header).alias("header"), event.alias("event"), look.alias("look"), F.when(F.size(wrongs) > 0, wrongs).alias("wrongs"), "file")
        lines = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["raw"])
        keep = lambda c: F.first(c, ignorenulls=True).alias(c)
        return rows.groupBy("doc_id", "part").agg(keep("format"), F.max("t").alias("t"), clean(F.array_join(lines, "\n")).alias("text"), F.array_sort(F.collect_list("header")).alias("headers"), keep("event"), keep("look"), F.flatten(F.collect_list("wrongs")).alias("wrongs"), keep("file"))

    def tagged(self, rows: DataFrame) -> DataFrame:
        """doc_id, kind and one of document, header, cue, style, error."""
        found, col, null, zero = self.joined(self.scanned(rows)), F.col, F.lit(None), F.lit(0)
        kept = [c for c in rows.schema["file"].dataType.names if c != "_"]
        own = [wrong(col("t.wrong").isNotNull(), col("t.ln") + 1, col("t.wrong")), wrong(col("t").isNotNull() & (col("text") == ""), col("t.ln") + 2, F.lit("altyazi metni bos"))]
        wrongs = F.transform(F.concat("wrongs", F.array_compact(F.array(*own))), lambda e: F.struct(col("format"), e["line"], e["message"]).cast(ERROR))
        timed = F.struct("t.seq", "t.cue_no", "t.start_ms", "t.end_ms", "text", null, null, zero, zero, zero, F.lit(""), zero, F.lit("dialogue")).cast(CUE)
        cue = F.coalesce("event", F.when(col("t").isNotNull(), timed))
        pairs = F.transform("headers", lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))
        document = F.when(col("file").isNotNull(), F.struct("format", *(col(f"file.`{c}`") for c in kept), pairs.alias("headers")))
        kinds = {"document": document, "cue": cue, "style": col("look"), "error": F.lit(None).cast(ERROR), "header": F.lit(None).cast("struct<pos:int,name:string,value:string>")}

        def tag(kind: str, value: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), *((value if k == kind else F.when(F.lit(False), v)).alias(k) for k, v in kinds.items()))

        one = F.array_compact(F.array(*(F.when(v.isNotNull(), tag(k, v)) for k, v in kinds.items() if k in ("document", "cue", "style"))))
        rows = F.concat(one, F.transform(wrongs, lambda e: tag("error", e)), F.transform("headers", lambda h: tag("header", h)))
        return found.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def exploded(files: DataFrame) -> DataFrame:
    """A row for each line of files of a known format (ln from 0, raw, arrow_next: the next line has an arrow), and one for
    each document (ln -1), which alone has file: the other columns of files."""
    kept = [c for c in files.columns if c not in ("doc_id", "text", "format")]
    file = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in kept))
    files = files.select("doc_id", "format", file.alias("file"), "text", F.coalesce(physical_lines(), F.array().cast("array<string>")).alias("lines"))
    following = F.zip_with("lines", F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(1))), lambda x, y: F.struct(x.alias("raw"), F.coalesce(y.contains(ARROW), F.lit(False)).alias("arrow_next")))
    following = F.when(F.col("format").isNotNull(), following).otherwise(F.array().cast("array<struct<raw:string,arrow_next:boolean>>"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("raw"), F.lit(False).alias("arrow_next")))
    titled = F.coalesce(F.get("lines", F.lit(0)).startswith("WEBVTT"), F.lit(False))
    rows = files.select("doc_id", "format", titled.alias("titled"), F.size("lines").alias("n"), (F.col("text") == "").alias("empty"), "file", F.posexplode(F.concat(own, following)).alias("p", "x"))
    return rows.select("doc_id", "format", "titled", "n", "empty", F.when(F.col("p") == 0, F.col("file")).alias("file"), (F.col("p") - 1).alias("ln"), "x.raw", "x.arrow_next")


def first_states(rows: DataFrame, formats: tuple[str, ...], size: int) -> DataFrame:
    """doc_id, chunk, start (STATE) of every chunk of the SRT and WebVTT documents of more than `size` lines."""
    col, zero, none = F.col, F.lit(0).cast(LONG), F.lit(None).cast(LONG)
    rows = rows.where((col("n") > size) & (col("ln") >= 0) & col("format").isin("srt", "vtt"))
    most = F.when(col("chunk") == 0, 0).when(col("format") == "vtt", RULES).otherwise(TEXT)
    rows = rows.withColumn("hyp", F.explode(F.sequence(F.lit(0), most)))
    rows = rows.withColumn("start", F.struct("hyp", none.alias("value"), zero.alias("inc"), zero.alias("lead"), zero.alias("cues"), zero.alias("heads"), (col("base") - 1).alias("blank"), F.lit(None).cast("struct<ln:int,kind:string>").alias("first")).cast(STATE))
    formats = tuple(f for f in formats if f != "ass")
    rows, ends, parts = Scan(formats, ("doc_id", "chunk", "hyp"), True).scanned(rows), [], []
    true = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast(LONG)
    no = {"inc": zero, "lead": none, "takes": F.lit(False), "cues": zero, "heads": zero, "first": F.lit(None).cast("struct<ln:int,kind:string>")}
    if "srt" in formats:
        ends.append((col("format") == "srt", F.when(col("s_opens"), TAKING).when(col("s_text") | col("s_at"), TEXT).otherwise(FRESH)))
        takes = F.max(F.coalesce(col("s_at") & col("s_takes") & (col("ln") == col("base")), F.lit(False)))
        parts.append({"inc": true(col("s_start")), "lead": F.max("s_lead"), "takes": takes, "cues": true(col("s_at"))})
    if "vtt" in formats:
        decided = F.when(F.coalesce(col("v_first.kind") == "style", col("hyp") == RULES), RULES).otherwise(DECIDED)
        ends.append((col("format") == "vtt", F.when(col("v_header"), HEADER).when(col("v_live") & col("v_decided"), decided).otherwise(OPEN)))
        parts.append({"cues": true(col("v_leads") & col("v_kind").isin("arrow", "name")), "heads": true(col("v_head")), "first": F.max(F.when(col("v_leads"), F.struct("ln", col("v_kind").alias("kind"))))})
    value = col("s_value") if "srt" in formats else none
    end = F.max_by(F.struct(reduce(lambda x, y: x.when(*y), ends[1:], F.when(*ends[0])).alias("hyp"), value.alias("value")), "ln")
    # A line counts for its own format only, so the formats' sums add up.
    whole_ = {c: reduce(lambda x, y: x + y, [p[c] for p in parts if c in p]) if c == "cues" else next((p[c] for p in parts if c in p), v) for c, v in no.items()}
    made = rows.groupBy("doc_id", "chunk", "hyp").agg(F.struct(end.alias("end"), F.max(F.when(col("blank"), col("ln"))).alias("blank"), *(v.alias(c) for c, v in whole_.items())).alias("sum"))
    chunks = made.groupBy("doc_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("hyp", "sum"))).alias("sums"))
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.map_entries("sums").alias("sums")))).alias("chunks"))
    begin = F.struct(F.lit(0).alias("hyp"), none.alias("value"), zero.alias("inc"), zero.alias("lead"), zero.alias("cues"), zero.alias("heads"), F.lit(-1).alias("blank"), no["first"].alias("first")).cast(STATE)
    out = "array<struct<chunk:bigint,start:" + STATE + ">>"

    def step(acc: Column, c: Column) -> Column:
        at = acc["state"]
        x = F.get(F.filter(c["sums"], lambda e: e["key"] == at["hyp"]), F.lit(0))["value"]
        taken = F.when(x["takes"], F.greatest(at["value"], F.lit(1)))
        lead = F.greatest(at["lead"], F.greatest(x["lead"], taken) - at["inc"])
        state = F.struct(x["end"]["hyp"].alias("hyp"), x["end"]["value"].alias("value"), (at["inc"] + x["inc"]).alias("inc"), lead.alias("lead"), (at["cues"] + x["cues"]).alias("cues"), (at["heads"] + x["heads"]).alias("heads"), F.coalesce(x["blank"], at["blank"]).alias("blank"), F.coalesce(x["first"], at["first"]).alias("first")).cast(STATE)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(F.struct(c["chunk"].cast(LONG).alias("chunk"), at.alias("start"))).cast(out)).alias("out"))

    folded = F.aggregate("chunks", F.struct(begin.alias("state"), F.array().cast(out).alias("out")), step, lambda acc: acc["out"])
    return listed.select("doc_id", F.explode(folded).alias("x")).select("doc_id", F.col("x.chunk").cast("int").alias("chunk"), "x.start")


def tagged(files: DataFrame, formats: tuple[str, ...] = FORMATS, chunk: int | None = None, buckets: int | None = None) -> DataFrame:
    """The tagged rows of files (doc_id, text, format and more, which documents keep): one scan, one exchange by doc_id, into
    `buckets` partitions where they are given. With `chunk`, the lines of SRT and WebVTT documents are scanned in chunks of so
    many; ASS documents stay whole."""
    rows = exploded(files)
    if buckets is not None:
        if chunk is not None:
            raise ValueError("chunks of documents can't be bucketed by document in the same exchange")
        rows = rows.repartition(buckets, "doc_id")
    if chunk is None or not {"srt", "vtt"} & set(formats):
        return Scan(formats).tagged(rows)
    number = F.when(F.col("format").isin("srt", "vtt") & (F.col("ln") >= 0), F.floor(F.col("ln") / chunk)).otherwise(0).cast("int")
    rows = rows.withColumn("chunk", number).withColumn("base", F.col("chunk") * chunk)
    starts = first_states(rows, formats, chunk)
    zero = F.lit(0).cast(LONG)
    begin = F.struct(F.lit(0), F.lit(None), zero, zero, zero, zero, F.lit(-1), F.lit(None)).cast(STATE)
    rows = rows.join(starts, ["doc_id", "chunk"], "left").withColumn("start", F.coalesce("start", begin))
    return Scan(formats, ("doc_id", "chunk"), True).tagged(rows)
