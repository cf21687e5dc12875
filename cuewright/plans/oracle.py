"""Equivalent SQL (DuckDB) for the registered queries, over the same tables."""

from __future__ import annotations

from cuewright.operators.defaults import EVENT_FORMAT
from cuewright.operators.rules import RULES
from cuewright.plans.derived import CUES, CUES_DOCS, LINES

CUES_SQL = CUES.replace("{conversations}", "conversations")
WITH = f"""WITH cues AS ({CUES_SQL}), lines AS ({LINES}), cues_docs AS ({CUES_DOCS.replace('{lines}', 'lines')}),
ids AS (SELECT DISTINCT conv_id AS doc_id FROM conversations),
styles AS (SELECT doc_id, p AS style_pos, CASE p WHEN 0 THEN 'Default' ELSE 'AltBaslik' END AS name FROM ids, (VALUES (0), (1)) v(p) WHERE doc_id % 3 <> 0),
"""


def div(a: str, b: str) -> str:
    return f"(({a}) // ({b}))"


def two(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), CAST(greatest(2, length(CAST({x} AS VARCHAR))) AS INT), '0')"


def three(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 3, '0')"


def long_time(x: str, dot: str) -> str:
    return f"{two(div(x, '3600000'))} || ':' || {two(div(x, '60000') + ' % 60')} || ':' || {two(div(x, '1000') + ' % 60')} || '{dot}' || {three(f'({x}) % 1000')}"


def srt_time(x: str) -> str:
    return long_time(x, ",")


def vtt_time(x: str) -> str:
    short = f"{two(div(x, '60000') + ' % 60')} || ':' || {two(div(x, '1000') + ' % 60')} || '.' || {three(f'({x}) % 1000')}"
    return f"CASE WHEN ({x}) < 3600000 THEN {short} ELSE {long_time(x, '.')} END"


def ass_time(x: str) -> str:
    c = f"((({x}) + 5) // 10)"
    return f"CAST({div(c, '360000')} AS VARCHAR) || ':' || {two(div(c, '6000') + ' % 60')} || ':' || {two(div(c, '100') + ' % 60')} || '.' || {two(f'{c} % 100')}"


CHARS = "length(replace(text, chr(10), ''))"
SPAN = "(end_ms - start_ms)"
N_LINES = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END"
SPEED = f"CASE WHEN {SPAN} <= 0 THEN 0.0::DOUBLE ELSE {CHARS} / ({SPAN} / 1000.0::DOUBLE) END"


def need(least: str, speed: str) -> str:
    return f"greatest({least}, CAST(ceil({CHARS} / {speed} * 1000.0::DOUBLE) AS BIGINT))"


def frame(ms: str, num: int, den: int) -> str:
    return f"((2 * ({ms}) * {num} + 1000 * {den}) // (2000 * {den}))"


def frame_time(f: str, num: int, den: int) -> str:
    return f"((2 * ({f}) * 1000 * {den} + {num}) // (2 * {num}))"


def snap(ms: str, num: int, den: int) -> str:
    return frame_time(frame(ms, num, den), num, den)


PAL, NTSC = (25, 1), (24000, 1001)


def findings(source: str = "cues", speed: str = "17.0::DOUBLE", least: str = "1000", slow: str = "6.0::DOUBLE", chars: str = "42", rows: str = "2", gap: str = "0", join: str = "") -> str:
    """The findings of rules 1 to 5 of a cue table, as the reports show them."""
    lag = "OVER (PARTITION BY doc_id ORDER BY seq)"
    return f"""near AS (SELECT *, lag(start_ms) {lag} AS prev_start, lag(cue_no) {lag} AS prev_no, lead(start_ms) {lag} AS next_start,
  lead(end_ms) {lag} AS next_end, lead(cue_no) {lag} AS next_no, {CHARS} AS chars, {SPAN} AS span, {SPEED} AS speed FROM {source}),
cue AS (SELECT near.*, {speed} AS t_speed, {least} AS t_least, {slow} AS t_slow, {chars} AS t_chars, {rows} AS t_rows, {gap} AS t_gap FROM near {join}),
needed AS (SELECT *, greatest(t_least, CAST(ceil(chars / t_slow * 1000.0::DOUBLE) AS BIGINT)) AS need FROM cue),
findings AS (
SELECT doc_id, seq, '{RULES[0]}' AS rule, 'uyari' AS severity, cue_no, NULL::BIGINT AS related_cue_no, 0 AS line, printf('%.1f', speed) || ' karakter/sn' AS measured,
  printf('%.1f', t_speed) || ' karakter/sn' AS threshold, 'replik ' || cue_no || ' icinde ' || printf('%.1f', speed) || ' karakter/saniye okunuyor' AS message FROM needed WHERE span > 0 AND speed > t_speed
UNION ALL SELECT doc_id, seq, '{RULES[1]}', 'uyari', cue_no, NULL, 0, span || ' ms (' || chars || ' karakter)', need || ' ms',
  'replik ' || cue_no || ' yalnizca ' || span || ' ms kaliyor, ' || chars || ' karakter icin gereken ' || need || ' ms' FROM needed WHERE span >= 0 AND span < need
UNION ALL SELECT doc_id, seq, '{RULES[2]}', 'uyari', cue_no, NULL, i, length(l) || ' karakter', t_chars || ' karakter',
  'replik ' || cue_no || ' satir ' || i || ' cok uzun (' || length(l) || ' karakter)' FROM
  (SELECT *, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM needed) WHERE length(l) > t_chars
UNION ALL SELECT doc_id, seq, '{RULES[2]}', 'uyari', cue_no, NULL, 0, ({N_LINES}) || ' satir', t_rows || ' satir',
  'replik ' || cue_no || '''da ' || ({N_LINES}) || ' satir var, okunabilir en fazla ' || t_rows || ' satir olabilir' FROM needed WHERE ({N_LINES}) > t_rows
UNION ALL SELECT doc_id, seq, '{RULES[3]}', 'kritik', cue_no, next_no, 0, (end_ms - next_start) || ' ms cakisma', '> ' || t_gap || ' ms',
  'replik ' || cue_no || ' ve ' || next_no || ' ayni anda ekranda gorunebiliyor (' || (end_ms - next_start) || ' ms)' FROM needed
  WHERE span >= 0 AND next_end >= next_start AND end_ms - next_start > t_gap
UNION ALL SELECT doc_id, seq, '{RULES[4]}', 'kritik', cue_no, NULL, 0, span || ' ms', '0 ms', 'replik ' || cue_no || '''da bitis baslangictan once (' || span || ' ms negatif sure)' FROM needed WHERE span < 0
UNION ALL SELECT doc_id, seq, '{RULES[4]}', 'kritik', cue_no, NULL, 0, '0 ms', '> 0 ms', 'replik ' || cue_no || '''da baslangic ve bitis ayni' FROM needed WHERE span = 0
UNION ALL SELECT doc_id, seq, '{RULES[4]}', 'kritik', cue_no, NULL, 0, {srt_time('start_ms')} || ' < ' || {srt_time('prev_start')}, 'baslangic artan sirada',
  'replik ' || cue_no || ' onceki replik ' || prev_no || '''den once basliyor; dosya sirasi bozuk' FROM needed WHERE start_ms < prev_start)
"""


def rule(k: int, where: str = "true") -> str:
    return WITH + findings() + f"SELECT doc_id, severity, cue_no, related_cue_no, line, measured, threshold, message FROM findings WHERE rule = '{RULES[k]}' AND {where}"


ORDER = "CASE rule " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(RULES)) + " END"
STATS = f"stats AS (SELECT doc_id, count(*) AS n_cues, CAST(sum({N_LINES}) AS BIGINT) AS n_lines, max(end_ms) AS last_end_ms FROM cues GROUP BY doc_id)"
UNDEFINED = "undefined AS (SELECT doc_id, string_agg(style, ',' ORDER BY style) AS styles FROM (SELECT DISTINCT doc_id, style FROM cues c WHERE style IS NOT NULL AND NOT EXISTS (SELECT 1 FROM styles s WHERE s.doc_id = c.doc_id AND lower(s.name) = lower(c.style))) GROUP BY doc_id)"
COUNTS = f"""counts AS (SELECT doc_id, count(*) AS n_findings, count(*) FILTER (severity = 'kritik') AS n_critical,
  string_agg(cue_no || '|' || line || '|' || rule, ';' ORDER BY cue_no, line, {ORDER}, message) AS findings FROM findings GROUP BY doc_id)"""
DOCS = """docs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'vtt' END AS format, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_headers FROM ids)"""
RAW_SRT = f"raw_srt AS (SELECT doc_id, string_agg(cue_no || chr(10) || {srt_time('start_ms')} || ' --> ' || {srt_time('end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY seq) AS text FROM cues GROUP BY doc_id)"
RAW_VTT = f"raw_vtt AS (SELECT doc_id, 'WEBVTT' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Title: t' || chr(10) || 'ScriptType: v4.00+' || chr(10) ELSE '' END || chr(10) || string_agg(({vtt_time('start_ms')}) || ' --> ' || ({vtt_time('end_ms')}) || chr(10) || text || chr(10) || chr(10), '' ORDER BY seq) AS text FROM cues GROUP BY doc_id)"
RAW_ASS = f"""raw_ass AS (SELECT doc_id, '[Script Info]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Title: t' || chr(10) || 'ScriptType: v4.00+' || chr(10) ELSE '' END || chr(10) || '[V4+ Styles]' || chr(10) || 'Format: Name, Fontname, Fontsize' || chr(10)
  || CASE WHEN doc_id % 3 <> 0 THEN 'Style: Default,Arial,48' || chr(10) || 'Style: AltBaslik,Arial,48' || chr(10) ELSE '' END || chr(10) || '[Events]' || chr(10) || 'Format: {', '.join(EVENT_FORMAT)}' || chr(10)
  || string_agg(CASE event_kind WHEN 'comment' THEN 'Comment' ELSE 'Dialogue' END || ': ' || layer || ',' || {ass_time('start_ms')} || ',' || {ass_time('end_ms')} || ',' || coalesce(style, '') || ',' || coalesce(speaker, '') || ',0,0,' || margin_v || ',' || effect || ',' || replace(text, chr(10), ' ') || chr(10), '' ORDER BY seq) AS text FROM cues GROUP BY doc_id)"""
ASS_MS = "(({0} + 5) // 10 * 10)"
KEYS = "doc_id, seq, cue_no, start_ms, end_ms, text"
RAW = f"{RAW_SRT}, {RAW_VTT}, {RAW_ASS}, mixed AS (SELECT doc_id, text FROM raw_srt WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text FROM raw_ass WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, text FROM raw_vtt WHERE doc_id % 3 = 2)"
FOUND = f"found AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'vtt' END AS format FROM mixed UNION ALL SELECT doc_id + 1000000000, CASE WHEN contains(array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)), '-->') THEN 'srt' END FROM documents)"
#: Plain texts hold no arrows; what the parsers make of each line without them.
PLAIN = """plain AS (SELECT doc_id, ln, l, ln = n - 1 AS last FROM (SELECT doc_id, i - 1 AS ln, rtrim(s[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS l, n FROM
  (SELECT doc_id, s, n, unnest(generate_series(1, n)) AS i FROM (SELECT doc_id, s, CASE WHEN s[-1] = '' THEN len(s) - 1 ELSE len(s) END AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))))"""
FILES = r"""files AS (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7fà-ÿ]', 'e', 'g') AS latin, doc_id % 4 AS kind FROM documents),
coded AS (SELECT *, CASE WHEN kind < 2 THEN text WHEN kind = 2 THEN latin ELSE 'é' || chr(10) || latin END AS body,
  kind >= 2 AND regexp_matches(latin, '[à-ÿ]') AS broken FROM files)"""
TURKISH = "replace(replace(replace(replace(replace(replace(latin, 'ð', 'ğ'), 'ý', 'ı'), 'þ', 'ş'), 'ÿ', 'Ÿ'), 'Ð', 'Ğ'), 'Ý', 'İ')"
HIGH = "len(list_filter(string_split(latin, chr(10)), lambda x: regexp_matches(x, '[à-ÿ]')))"
NORMAL = f"""snapped AS (SELECT *, {snap('start_ms', *PAL)} AS s, {snap('end_ms', *PAL)} AS e FROM {{0}}),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, seq) AS new, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS old FROM snapped),
there AS (SELECT a.*, (a.cue_no, a.s, a.e, a.text) IS DISTINCT FROM (b.cue_no, b.s, b.e, b.text) AS moved FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.new = b.old)
SELECT doc_id, count(*) FILTER (s <> start_ms OR e <> end_ms) AS snapped, count(*) FILTER (moved) AS sorted, count(*) FILTER (new <> cue_no) AS renumbered,
  greatest(max(CASE WHEN e <= s THEN s + 40 ELSE e END), 0) AS total_ms FROM there GROUP BY doc_id"""
LOSS = "agg AS (SELECT doc_id, min_by(style, seq) FILTER (style IS NOT NULL) AS style, bool_or(effect <> '' OR margin_v <> 0) AS margins, bool_or(event_kind = 'comment') AS comments, bool_or(layer <> 0) AS layers FROM cues GROUP BY doc_id), base AS (SELECT docs.*, agg.* EXCLUDE doc_id, CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 0 END AS n_styles FROM docs LEFT JOIN agg USING (doc_id))"


def lost(target: str, parts: list[tuple[str, str, str, str]]) -> list[str]:
    return [f"SELECT doc_id, '{target}' AS target, {i} AS k, '{f}' AS feature, {v} AS value, '{r}' AS reason FROM base WHERE {w}" for i, (w, f, v, r) in enumerate(parts)]


EDGES, HIDDEN = ("margins", "kenar bosluklari ve efekt", "'MarginL/MarginR/MarginV/Effect'"), ("comments", "Comment satirlari", "'gizli replikler'")
LOSSES = " UNION ALL ".join(
    lost("srt", [("n_styles > 0", "ASS stiller", "n_styles || ' stil'", "SRT stil tasimaz; metin ve zamanlama korunur"), ("style IS NOT NULL", "replik stili", "style", "SRT stil tasimaz"), (*EDGES, "SRT bu alanlari icermez"), ("n_headers > 0", "baslik bloklari", "n_headers || ' alan'", "SRT baslik bolumu tanimlamaz"), (*HIDDEN, "SRT yorum satiri icermez; tumu normal replige donustu")])
    + lost("vtt", [("n_styles > 0", "ASS stiller", "n_styles || ' stil'", "WebVTT `STYLE` blogu kullanilir, ASS `Style:` tablosu degil"), ("style IS NOT NULL", "replik stili", "style", "WebVTT replik ici stil tasimaz; CSS sinifi kullanilir"), (*EDGES, "WebVTT cue ayarlari kenar boslugu icermez"), (*HIDDEN, "WebVTT `NOTE` blogu kullanilir; icerik replik olarak tasindi")])
    + lost("ass", [("n_headers > 0", "baslik bloklari", "n_headers || ' alan'", "ASS `Script Info` blogu varsayilan degerlerle yeniden uretildi"), ("n_styles = 0", "stil tablosu", "'yok'", "kaynak bicim stil tasimiyor; `Default` stili uretildi"), ("style IS NULL", "replik stili", "'yok'", "kaynak belgede replik stili yok; tumu `Default` stiline baglandi"), ("style IS NOT NULL AND n_styles = 0", "replik stili", "'stil adlari'", "kaynak belgede stil tablosu yok; `Default` stili uretildi"), ("layers", "replik katmani", "'Layer'", "SRT ve WebVTT katman bilgisi tasimaz")])
)
INFO = "(VALUES ('Title', 'untitled'), ('ScriptType', 'v4+'), ('WrapStyle', '0'), ('PlayResX', 'x'), ('PlayResY', 'y'), ('ScaledBorderAndShadow', 'yes')) v(name, given)"
SHIFTED = "(greatest(start_ms - 1400, 0) <> start_ms OR greatest(end_ms - 1400, 0) <> end_ms)"
PERCENT = "round(max(end_ms) OVER (PARTITION BY doc_id) * (-10.0::DOUBLE) / 100.0::DOUBLE)::BIGINT"

ORACLE_SQL: dict[str, str] = {
    "read_files": WITH + RAW_SRT + ", n AS (SELECT doc_id, count(*) AS n_cues FROM cues GROUP BY doc_id) SELECT doc_id, 'srt' AS format, 'utf-8' AS encoding, length(text) AS n_chars, n_cues FROM raw_srt JOIN n USING (doc_id)",
    "detect_format": WITH + RAW + ", " + FOUND + " SELECT * FROM found",
    "force_format": WITH + RAW + ", " + FOUND + " SELECT doc_id, CASE WHEN format IS NOT NULL THEN CASE WHEN doc_id % 5 = 0 THEN 'vtt' ELSE format END END AS format FROM found",
    "parse_srt": WITH.rstrip(", \n") + f" SELECT {KEYS} FROM cues",
    "parse_vtt": WITH.rstrip(", \n") + f" SELECT {KEYS} FROM cues",
    "parse_ass_events": WITH.rstrip(", \n") + f" SELECT doc_id, seq, cue_no, {ASS_MS.format('start_ms')} AS start_ms, {ASS_MS.format('end_ms')} AS end_ms, replace(text, chr(10), ' ') AS text, style, speaker, margin_l, margin_r, margin_v, effect, layer, event_kind FROM cues",
    "parse_ass_styles": WITH.rstrip(", \n") + " SELECT doc_id, style_pos, name, 3 AS n_fields, '48' AS fontsize FROM styles",
    "parse_headers": WITH.rstrip(", \n") + " SELECT doc_id, pos, name, value, source FROM ids, (VALUES (0, 'Title', 't'), (1, 'ScriptType', 'v4.00+')) v(pos, name, value), (VALUES ('vtt'), ('ass')) w(source) WHERE doc_id % 2 = 0",
    "syntax_errors": WITH + PLAIN + r""", numbered AS (SELECT *, l <> '' AND regexp_matches(l, '^\+?[0-9]+$') AND TRY_CAST(l AS HUGEINT) <= 4294967295 AS num FROM plain),
      tail AS (SELECT doc_id, ln, l, last FROM numbered)
      SELECT doc_id, 'srt' AS format, CAST(ln + 1 AS INT) AS line, 'zaman cizgisinde ''-->'' ayraci yok: ''' || l || '''' AS message FROM numbered WHERE l <> '' AND NOT num
      UNION ALL SELECT doc_id, 'vtt', 1, 'ilk satir ''WEBVTT'' ile baslamiyor: ''' || l || '''' FROM tail WHERE ln = 0
      UNION ALL SELECT doc_id, 'vtt', ln + 1, 'zaman cizgisi bulunamadi: ''' || l || '''' FROM tail WHERE l <> ''
      UNION ALL SELECT doc_id, 'ass', ln + 1, 'bolum basligi olmayan satir: ''' || l || '''' FROM tail WHERE l <> ''""",
    "render_srt": WITH + RAW_SRT + " SELECT * FROM raw_srt",
    "render_vtt": WITH + RAW_VTT + " SELECT * FROM raw_vtt",
    "render_ass": WITH + RAW_ASS + " SELECT * FROM raw_ass",
    "write_documents": WITH + RAW_VTT + " SELECT doc_id, length(text) AS n_chars FROM raw_vtt",
    "read_profile": WITH.rstrip(", \n") + " SELECT doc_id, 30.0::DOUBLE AS okuma_hizi, 500 AS asgari_dinlenme_ms, 12.0::DOUBLE AS asgari_hiz, CASE WHEN doc_id % 4 = 0 THEN 60 ELSE 42 END AS en_fazla_karakter, 2 AS en_fazla_satir, 2000 AS kabul_edilebilir_bosluk_ms FROM ids WHERE doc_id % 2 = 0",
    "bom_sniff": "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'utf-8-bom' END AS encoding, CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 0 END AS mark_bytes, CASE WHEN doc_id % 4 = 1 THEN 'dosya UTF-8 BOM ile basliyor' END AS note FROM documents",
    "decode_text": f"WITH {FILES}, shown AS (SELECT doc_id, CASE WHEN NOT broken THEN body WHEN kind = 3 THEN 'Ã©' || chr(10) || {TURKISH} ELSE {TURKISH} END AS t FROM coded) SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM shown",
    "mixed_encoding": f"WITH {FILES} SELECT doc_id, CASE WHEN kind < 2 THEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x00-\\x7f]'))) + CASE WHEN kind = 1 AND NOT regexp_matches(string_split(text, chr(10))[1], '[^\\x00-\\x7f]') THEN 1 ELSE 0 END WHEN kind = 3 THEN 1 ELSE 0 END AS utf8_lines, CASE WHEN kind >= 2 THEN {HIGH} ELSE 0 END AS single_byte_lines, kind = 3 AND {HIGH} > 0 AS mixed FROM coded",
    "parse_timestamp": WITH.rstrip(", \n") + f" SELECT doc_id, seq, start_ms AS srt_ms, {ASS_MS.format('start_ms')} AS ass_ms, start_ms AS vtt_ms FROM cues",
    "format_srt_time": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {srt_time('start_ms')} AS shown FROM cues_docs",
    "format_ass_time": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {ass_time('start_ms')} AS shown FROM cues_docs",
    "format_vtt_time": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {vtt_time('start_ms')} AS shown FROM cues_docs",
    "duration_text": WITH.rstrip(", \n") + f" SELECT doc_id, {long_time('x', '.')} AS duration FROM (SELECT doc_id, max(end_ms) AS x FROM cues_docs GROUP BY doc_id)",
    "cue_metrics": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {SPAN} AS duration_ms, {CHARS} AS n_chars, {N_LINES} AS n_lines, CASE WHEN text = '' THEN 0 ELSE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) END AS longest_line, {SPAN} >= 0 AS valid FROM cues",
    "reading_speed": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {SPEED} AS speed FROM cues",
    "required_duration": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {need('1000', '6.0::DOUBLE')} AS required_ms FROM cues",
    "fps_fraction": WITH + "rates AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 23.976::DOUBLE WHEN 1 THEN 29.97::DOUBLE ELSE (doc_id % 1200) / 10.0::DOUBLE END AS r FROM ids), near AS (SELECT *, floor(r * 1001 / 1000.0::DOUBLE + 0.5) AS n FROM rates), pairs AS (SELECT doc_id, r, CASE WHEN n >= 1 AND abs(r - n * 1000.0::DOUBLE / 1001) < 0.002 THEN [n * 1000, 1001] WHEN abs(r * 100 - floor(r * 100 + 0.5)) < 1e-6 THEN [floor(r * 100 + 0.5), 100] ELSE [floor(r + 0.5), 1] END::BIGINT[] AS f FROM near) SELECT doc_id, CASE WHEN r BETWEEN 1 AND 1000 THEN f[1] // gcd(f[1], f[2]) END AS num, CASE WHEN r BETWEEN 1 AND 1000 THEN f[2] // gcd(f[1], f[2]) END AS den FROM pairs",
    "frame_number": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {frame('start_ms', *NTSC)} AS frame FROM cues",
    "frame_to_ms": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {frame_time('cue_no', *NTSC)} AS ms FROM cues",
    "snap_to_frame": WITH.rstrip(", \n") + f" SELECT doc_id, seq, {snap('start_ms', *NTSC)} AS ntsc_ms, {snap('end_ms', *PAL)} AS pal_ms FROM cues",
    "format_name": "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' WHEN 2 THEN 'vtt' WHEN 3 THEN 'srt' WHEN 5 THEN 'ass' END AS format FROM conversations",
    "event_kind": WITH.rstrip(", \n") + " SELECT doc_id, seq, event_kind AS kind, CASE event_kind WHEN 'comment' THEN 'Comment' ELSE 'Dialogue' END AS tag FROM cues",
    "style_field": WITH.rstrip(", \n") + " SELECT doc_id, name, 'Arial' AS font, '' AS none, '20' AS size, 4 AS n_fields FROM styles",
    "script_type": WITH.rstrip(", \n") + " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v4.00+' ELSE 'v4+ (belirtilmemis)' END AS script_type FROM ids",
    "rule_reading_speed": rule(0),
    "rule_min_duration": rule(1),
    "rule_line_length": rule(2, "line > 0"),
    "rule_line_count": rule(2, "line = 0"),
    "rule_overlap": rule(3),
    "rule_negative_or_zero": rule(4, "threshold <> 'baslangic artan sirada'"),
    "rule_order": rule(4, "threshold = 'baslangic artan sirada'"),
    "undefined_styles": WITH + UNDEFINED + " SELECT * FROM undefined",
    "check_with_profile": WITH + "profiles AS (SELECT doc_id AS p_id FROM ids WHERE doc_id % 2 = 0), " + findings(speed="CASE WHEN p_id IS NULL THEN 17.0::DOUBLE ELSE 30.0::DOUBLE END", least="CASE WHEN p_id IS NULL THEN 1000 ELSE 500 END", slow="CASE WHEN p_id IS NULL THEN 6.0::DOUBLE ELSE 12.0::DOUBLE END", chars="CASE WHEN p_id % 4 = 0 THEN 60 ELSE 42 END", gap="CASE WHEN p_id IS NULL THEN 0 ELSE 2000 END", join="LEFT JOIN profiles ON doc_id = p_id") + " SELECT doc_id, rule, count(*) AS n, min(threshold) AS threshold FROM findings GROUP BY doc_id, rule",
    "shift_by_table": WITH.rstrip(", \n") + " SELECT doc_id, seq, greatest(start_ms + k, 0) AS start_ms, greatest(end_ms + k, 0) AS end_ms FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN doc_id * 37 % 5000 - 2500 ELSE 0 END AS k FROM cues)",
    "doc_stats": WITH + STATS + " SELECT doc_id, coalesce(n_cues, 0) AS n_cues, coalesce(n_lines, 0) AS n_lines, coalesce(last_end_ms, 0) AS last_end_ms FROM ids LEFT JOIN stats USING (doc_id)",
    "rule_summary": WITH + findings() + ", names AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in RULES) + f"]) AS rule) SELECT ids.doc_id, {ORDER.replace('rule', 'names.rule')} AS place, names.rule, count(f.rule) AS n_findings FROM ids CROSS JOIN names LEFT JOIN findings f ON f.doc_id = ids.doc_id AND f.rule = names.rule GROUP BY ALL",
    "longest_cue": WITH.rstrip(", \n") + f" SELECT doc_id, cue_no, n_chars FROM (SELECT doc_id, cue_no, {CHARS} AS n_chars, row_number() OVER (PARTITION BY doc_id ORDER BY {CHARS} DESC, seq DESC) AS k FROM cues) WHERE k = 1",
    "shift_amount": WITH.rstrip(", \n") + " SELECT doc_id, CAST(round((doc_id % 4001 - 2000) / 16.0::DOUBLE * 1000.0::DOUBLE) AS BIGINT) AS shift_ms FROM ids",
    "shift_ms": WITH.rstrip(", \n") + " SELECT doc_id, seq, greatest(start_ms - 1400, 0) AS start_ms, greatest(end_ms - 1400, 0) AS end_ms FROM cues",
    "shift_report": WITH.rstrip(", \n") + f" SELECT doc_id, -1400 AS requested_ms, -1400 AS applied_ms, count(*) FILTER (start_ms < 1400 OR end_ms < 1400) AS clipped, count(*) FILTER ({SHIFTED}) AS affected FROM cues GROUP BY doc_id",
    "shift_percent": WITH.rstrip(", \n") + f" SELECT doc_id, seq, greatest(start_ms + k, 0) AS start_ms, greatest(end_ms + k, 0) AS end_ms FROM (SELECT *, {PERCENT} AS k FROM cues)",
    "shift_percent_report": WITH + "shares AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 41 - 20) / 4.0::DOUBLE END AS p, max(end_ms) OVER (PARTITION BY doc_id) AS total FROM cues), deltas AS (SELECT *, CASE WHEN total > 0 AND p IS NOT NULL THEN CAST(round(total * p / 100.0::DOUBLE) AS BIGINT) ELSE 0 END AS k FROM shares) SELECT doc_id, max(k) AS requested_ms, max(k) AS applied_ms, count(*) FILTER (start_ms + k < 0 OR end_ms + k < 0) AS clipped, count(*) FILTER (greatest(start_ms + k, 0) <> start_ms OR greatest(end_ms + k, 0) <> end_ms) AS affected FROM deltas GROUP BY doc_id",
    "normalize_snap": WITH.rstrip(", \n") + f" SELECT doc_id, seq, s AS start_ms, e AS end_ms, s <> start_ms OR e <> end_ms AS snapped FROM (SELECT doc_id, seq, start_ms, end_ms, {snap('start_ms', *NTSC)} AS s, {snap('end_ms', *NTSC)} AS e FROM cues)",
    "normalize_sort": WITH + "placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, seq) AS new, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS old FROM cues) SELECT a.doc_id, a.new - 1 AS seq, a.cue_no, a.cue_no <> b.cue_no AS moved FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.new = b.old",
    "normalize_renumber": WITH.rstrip(", \n") + " SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS cue_no, row_number() OVER (PARTITION BY doc_id ORDER BY seq) <> cue_no + doc_id % 2 AS numbered FROM cues",
    "normalize_min_frame": WITH.rstrip(", \n") + " SELECT doc_id, seq, start_ms, CASE WHEN end_ms <= start_ms THEN start_ms + 40 ELSE end_ms END AS end_ms FROM cues",
    "normalize": WITH + NORMAL.replace("{0}", "cues"),
    "overlap_pairs": WITH + "n AS (SELECT *, lead(cue_no) OVER w AS cue_b, lead(start_ms) OVER w AS s, lead(end_ms) OVER w AS e FROM cues_docs WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, cue_no AS cue_a, cue_b, end_ms - s AS overlap_ms FROM n WHERE end_ms >= start_ms AND e >= s AND end_ms > s",
    "loss_report": WITH + DOCS + ", " + LOSS + f" SELECT doc_id, target, CAST(row_number() OVER (PARTITION BY doc_id, target ORDER BY k) - 1 AS INT) AS loss_pos, feature, value, reason FROM ({LOSSES})",
    "convert": WITH.rstrip(", \n") + " SELECT doc_id, 'ass' AS format, 23 AS n_style_fields, 10 AS n_event_fields, count(*) AS n_cues, count(*) FILTER (coalesce(style, 'Default') = 'Default') AS n_default FROM cues GROUP BY doc_id",
    "default_script_info": WITH + DOCS + f" SELECT doc_id, name, CASE name WHEN 'PlayResX' THEN CASE format WHEN 'vtt' THEN '1920' ELSE '384' END WHEN 'PlayResY' THEN CASE format WHEN 'vtt' THEN '1080' ELSE '288' END ELSE given END AS value FROM docs, {INFO}",
    "roundtrip": WITH.rstrip(", \n") + f" SELECT doc_id, seq, cue_no, {ASS_MS.format('start_ms')} AS start_ms, {ASS_MS.format('end_ms')} AS end_ms, replace(text, chr(10), ' ') AS text FROM cues",
    "sorted_cues": WITH.rstrip(", \n") + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, seq) AS place, seq, start_ms FROM cues",
    "check": WITH + findings() + " SELECT doc_id, rule, severity, count(*) AS n FROM findings GROUP BY ALL",
    "check_documents": WITH + findings("cues_docs") + " SELECT doc_id, rule, severity, count(*) AS n FROM findings GROUP BY ALL",
    "normalize_documents": WITH + NORMAL.replace("{0}", "cues_docs"),
    "ordered_findings": WITH + findings() + f" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cue_no, line, {ORDER}, message) AS rank, rule, cue_no, line FROM findings",
}

# Cues as they are read back from files: ASS has hundredths of seconds, no line ends, and alone styles, margins and comments.
LATIN_TURKISH = TURKISH.replace("(latin,", "(regexp_replace(text, '[^\\x00-\\x7fà-ÿ]', 'e', 'g'),")
SRC = f"""src AS (SELECT doc_id, seq, cue_no, is_ass, start_ms, end_ms, CASE WHEN doc_id % 7 IN (1, 2) THEN {LATIN_TURKISH} ELSE text END AS text, style, effect, margin_v, event_kind, e FROM (
  SELECT doc_id, seq, cue_no, doc_id % 3 = 1 AS is_ass, CASE WHEN doc_id % 3 = 1 THEN {ASS_MS.format('start_ms')} ELSE start_ms END AS start_ms, CASE WHEN doc_id % 3 = 1 THEN {ASS_MS.format('end_ms')} ELSE end_ms END AS end_ms,
  CASE WHEN doc_id % 3 = 1 THEN replace(text, chr(10), ' ') ELSE text END AS text, style, effect, margin_v, event_kind, CASE WHEN doc_id % 2 = 0 THEN chr(13) ELSE '' END || chr(10) AS e FROM cues))"""
#: Each file's encoding, and the errors of its last lines.
CODED = r"""body AS (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7fà-ÿ]', 'e', 'g') AS latin, len(string_split(text, chr(10))) AS n, doc_id % 7 AS k FROM mixed),
high AS (SELECT *, k IN (1, 2) AND regexp_matches(latin, '[à-ÿ]') AS broken FROM body),
enc AS (SELECT doc_id, n, CASE WHEN k = 3 THEN 'utf-16-le' WHEN k = 5 THEN 'utf-8-bom' WHEN broken THEN CASE k WHEN 1 THEN 'windows-1254' ELSE 'karisik' END ELSE 'utf-8' END AS encoding, k IN (3, 5) AS has_bom,
  CASE WHEN broken THEN length(regexp_replace(latin, '[^à-ÿ]', '', 'g')) ELSE 0 END AS bad_seq, 0 AS fffd, broken AND k = 2 AS mixed, CASE WHEN broken THEN len(list_filter(string_split(latin, chr(10)), lambda x: regexp_matches(x, '[à-ÿ]'))) ELSE 0 END AS single_byte_lines,
  CASE doc_id % 11 WHEN 4 THEN 'stray' WHEN 6 THEN '99' END AS stray, CASE WHEN k = 2 THEN CASE WHEN broken THEN 'Ã©' ELSE 'é' END END AS last FROM high),
files6 AS (SELECT doc_id, NULL::BIGINT AS seq, 'kodlama_bozuklugu' AS rule, 'uyari' AS severity, 0 AS cue_no, NULL::BIGINT AS related_cue_no, 0 AS line, encoding || ' (BOM)' AS measured, 'BOM''suz UTF-8' AS threshold, 'dosya bayt sirasi isareti (BOM) ile basliyor; bazi oynaticilar ilk satiri bos sayar' AS message FROM enc WHERE has_bom
  UNION ALL SELECT doc_id, NULL, 'kodlama_bozuklugu', 'kritik', 0, NULL, 0, single_byte_lines || ' tek bayt satir', 'tek kodlama', 'dosyada hem UTF-8 hem tek bayt satirlar var; kodlama karisik' FROM enc WHERE mixed
  UNION ALL SELECT doc_id, NULL, 'kodlama_bozuklugu', 'kritik', 0, NULL, 0, bad_seq || ' bozuk bayt dizisi', '0', 'dosyada UTF-8 olarak cozulemeyen bayt dizileri var' FROM enc WHERE bad_seq > 0),
wrong AS (SELECT doc_id, n AS line, 'zaman cizgisinde ''-->'' ayraci yok: ''' || stray || '''' AS message FROM enc WHERE doc_id % 3 = 0 AND stray = 'stray'
  UNION ALL SELECT doc_id, n, 'numara satiri var ama zaman cizgisi yok' FROM enc WHERE doc_id % 3 = 0 AND stray = '99' AND last IS NULL
  UNION ALL SELECT doc_id, n + (stray IS NOT NULL)::INT, 'zaman cizgisinde ''-->'' ayraci yok: ''' || last || '''' FROM enc WHERE doc_id % 3 = 0 AND last IS NOT NULL
  UNION ALL SELECT doc_id, n, 'zaman cizgisi bulunamadi: ''' || stray || '''' FROM enc WHERE doc_id % 3 = 2 AND stray IS NOT NULL
  UNION ALL SELECT doc_id, n + (stray IS NOT NULL)::INT, 'zaman cizgisi bulunamadi: ''' || last || '''' FROM enc WHERE doc_id % 3 = 2 AND last IS NOT NULL)"""
FEATURES = """string_agg(feature, ';' ORDER BY k) FILTER (feature IS NOT NULL)"""
ORACLE_SQL |= {
    "convert_files": WITH + SRC + f""", body AS (SELECT doc_id, string_agg(cue_no || e || {srt_time('start_ms')} || ' --> ' || {srt_time('end_ms')} || e || text || e || e, '' ORDER BY seq) AS text,
      min_by(style, seq) FILTER (is_ass AND style IS NOT NULL) AS style, coalesce(bool_or(is_ass AND (effect <> '' OR margin_v <> 0)), false) AS margins, coalesce(bool_or(is_ass AND event_kind = 'comment'), false) AS comments FROM src GROUP BY doc_id),
    lost AS (SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS k, unnest([CASE WHEN doc_id % 3 = 1 THEN 'ASS stiller=2 stil' END, 'replik stili=' || style, CASE WHEN margins THEN 'kenar bosluklari ve efekt=MarginL/MarginR/MarginV/Effect' END,
      CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 THEN 'baslik bloklari=2 alan' END, CASE WHEN comments THEN 'Comment satirlari=gizli replikler' END]) AS feature FROM body),
    losses AS (SELECT doc_id, {FEATURES} AS losses FROM lost GROUP BY doc_id)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'vtt' END AS source, length(text) AS n_chars, sha256(text) AS text_sha256, coalesce(losses, '') AS losses FROM body JOIN losses USING (doc_id)""",
    "check_files": WITH + RAW + ", " + CODED + ", " + SRC + ", " + findings("src") + """, every AS (SELECT * FROM findings UNION ALL SELECT * FROM files6),
    counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'kritik') AS c, count(*) FILTER (rule = 'kodlama_bozuklugu') AS e FROM every GROUP BY doc_id), wrongs AS (SELECT doc_id, count(*) AS w FROM wrong GROUP BY doc_id)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'vtt' END AS format, doc_id % 2 = 0 AS crlf, encoding, coalesce(counts.n, 0) AS n_findings, coalesce(c, 0) AS n_critical, coalesce(e, 0) AS n_encoding, coalesce(w, 0) AS n_syntax,
      coalesce(c, 0) = 0 AND coalesce(w, 0) = 0 AS passed FROM enc LEFT JOIN counts USING (doc_id) LEFT JOIN wrongs USING (doc_id)""",
}
P = {"speed": "CASE WHEN p_id IS NULL THEN 17.0::DOUBLE ELSE 30.0::DOUBLE END", "least": "CASE WHEN p_id IS NULL THEN 1000 ELSE 500 END", "slow": "CASE WHEN p_id IS NULL THEN 6.0::DOUBLE ELSE 12.0::DOUBLE END", "chars": "CASE WHEN p_id % 4 = 0 THEN 60 ELSE 42 END", "gap": "CASE WHEN p_id IS NULL THEN 0 ELSE 2000 END"}
REPORT = WITH + RAW + ", profiles AS (SELECT doc_id AS p_id FROM ids WHERE doc_id % 2 = 0), " + CODED + ", " + SRC + ", " + findings("src", **P, join="LEFT JOIN profiles ON doc_id = p_id") + f""", every AS (SELECT * FROM findings UNION ALL SELECT * FROM files6),
totals AS (SELECT doc_id, count(*) AS n_cues, CAST(sum({N_LINES}) AS BIGINT) AS n_lines, max(end_ms) AS last_end_ms, string_agg(DISTINCT style, ',') FILTER (is_ass AND style = 'YokBoyleStil') AS styles FROM src GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_findings, count(*) FILTER (severity = 'kritik') AS n_critical, count(*) FILTER (rule = '{RULES[5]}') AS n_encoding, {" || '|' || ".join(f"count(*) FILTER (rule = '{r}')" for r in RULES)} AS rule_counts,
  string_agg(cue_no || '|' || line || '|' || rule || '|' || severity || '|' || measured || '|' || threshold || '|' || message, ';' ORDER BY cue_no, line, {ORDER}, message) AS findings FROM every GROUP BY doc_id),
wrongs AS (SELECT doc_id, count(*) AS n_syntax, string_agg(CASE doc_id % 3 WHEN 0 THEN 'srt' ELSE 'vtt' END || '|' || line || '|' || message, ';' ORDER BY line) AS syntax_errors FROM wrong GROUP BY doc_id),
report AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'vtt' END AS format, doc_id % 2 = 0 AS crlf, n_cues, n_lines, last_end_ms, encoding, has_bom, bad_seq, fffd, mixed, single_byte_lines,
  CASE WHEN doc_id % 2 = 0 THEN '30.0|500|12.0|' || CASE WHEN doc_id % 4 = 0 THEN 60 ELSE 42 END || '|2|2000' ELSE '17.0|1000|6.0|42|2|0' END AS thresholds, coalesce(rule_counts, '0|0|0|0|0|0') AS rule_counts, coalesce(n_findings, 0) AS n_findings, coalesce(n_critical, 0) AS n_critical,
  coalesce(n_encoding, 0) AS n_encoding, coalesce(findings, '') AS findings, coalesce(styles, '') AS styles, coalesce(n_syntax, 0) AS n_syntax, coalesce(syntax_errors, '') AS syntax_errors FROM enc JOIN totals USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN wrongs USING (doc_id))
"""
EMPTY = {"n_findings": "BIGINT", "n_encoding": "BIGINT", "encoding": "VARCHAR", "affected": "BIGINT", "renumbered": "BIGINT", "first_loss": "VARCHAR"}


def reported(kind: str, source: str, **fields: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, " + ", ".join(f"{fields.get(c, f'NULL::{t}')} AS {c}" for c, t in EMPTY.items()) + f" FROM {source}"


#: Of the losses in WebVTT the first.
FIRST_LOSS = f"firsts AS (SELECT doc_id, CASE WHEN n_styles > 0 THEN 'ASS stiller' WHEN style IS NOT NULL THEN 'replik stili' WHEN margins THEN 'kenar bosluklari ve efekt' WHEN comments THEN 'Comment satirlari' END AS feature FROM base)"
KINDS_SQL = [reported("check", "report", n_findings="n_findings", n_encoding="n_encoding", encoding="encoding"), reported("shift", "shifts", affected="affected"), reported("normalize", "norms", renumbered="renumbered"), reported("convert", "firsts", first_loss="feature")]
ORACLE_SQL |= {
    "check_report": REPORT + "SELECT * EXCLUDE n_encoding FROM report",
    "report_summary": REPORT + f"SELECT doc_id, format, n_cues, n_lines, {long_time('last_end_ms', '.')} AS duration, encoding, n_findings, n_critical FROM report",
    "quality_gate": REPORT + "SELECT doc_id, n_critical = 0 AND n_syntax = 0 AS passed FROM report",
    "write_reports": REPORT + f", shifts AS (SELECT doc_id, count(*) FILTER ({SHIFTED}) AS affected FROM cues GROUP BY doc_id), norms AS (WITH {NORMAL.replace('{0}', 'cues')}), {DOCS}, {LOSS}, {FIRST_LOSS} " + " UNION ALL ".join(KINDS_SQL),
}
# The single-byte texts' high bytes are all lead bytes that nothing continues: each is an ill-formed sequence.
BAD = "CASE WHEN broken THEN length(regexp_replace(latin, '[^à-ÿ]', '', 'g')) ELSE 0 END"
AUDIT = f"WITH {FILES}, audit AS (SELECT doc_id, kind, broken, {BAD} AS bad, CASE WHEN broken THEN {HIGH} ELSE 0 END AS n FROM coded)"
ORACLE_SQL |= {
    "bad_sequences": AUDIT + " SELECT doc_id, bad AS bad_seq FROM audit",
    "encoding_report": AUDIT + " SELECT doc_id, CASE WHEN broken THEN CASE kind WHEN 3 THEN 'karisik' ELSE 'windows-1254' END WHEN kind = 1 THEN 'utf-8-bom' ELSE 'utf-8' END AS encoding, kind = 1 AS has_bom, bad AS bad_seq, 0 AS fffd, broken AND kind = 3 AS mixed, n AS single_byte_lines, CASE WHEN broken OR kind = 1 THEN 1 ELSE 0 END AS notes, NOT broken AND kind <> 1 AS healthy FROM audit",
    "rule_encoding": AUDIT + """ SELECT doc_id, 'uyari' AS severity, 'utf-8-bom (BOM)' AS measured, 'BOM''suz UTF-8' AS threshold, 'dosya bayt sirasi isareti (BOM) ile basliyor; bazi oynaticilar ilk satiri bos sayar' AS message FROM audit WHERE kind = 1
      UNION ALL SELECT doc_id, 'kritik', n || ' tek bayt satir', 'tek kodlama', 'dosyada hem UTF-8 hem tek bayt satirlar var; kodlama karisik' FROM audit WHERE broken AND kind = 3
      UNION ALL SELECT doc_id, 'kritik', bad || ' bozuk bayt dizisi', '0', 'dosyada UTF-8 olarak cozulemeyen bayt dizileri var' FROM audit WHERE broken""",
}
N_HEADERS = "CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END"
ORACLE_SQL |= {
    "read_parsed": WITH + "n AS (SELECT doc_id, count(*) AS n_cues FROM cues GROUP BY doc_id) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'vtt' END AS format, n_cues, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS n_styles, CASE WHEN doc_id % 11 IN (4, 6) AND doc_id % 3 <> 1 THEN 1 ELSE 0 END AS n_syntax, true AS read_once FROM n",
    "forced_files": WITH + RAW + ", " + FOUND + f""", n AS (SELECT doc_id, count(*) AS n_cues FROM cues GROUP BY doc_id),
    kinds AS (SELECT doc_id, format, coalesce(n_cues, 0) AS n_cues, format = 'srt' AND doc_id % 5 = 0 AS to_vtt, format = 'vtt' AND doc_id % 5 = 1 AS to_srt FROM found LEFT JOIN n USING (doc_id))
    SELECT doc_id, CASE WHEN to_vtt THEN 'vtt' WHEN to_srt THEN 'srt' ELSE format END AS format, n_cues, CAST(n_cues * (n_cues + 1) // 2 + CASE WHEN to_srt THEN n_cues * (1 + {N_HEADERS}) ELSE 0 END AS BIGINT) AS sum_no,
      CASE WHEN to_vtt THEN 1 WHEN to_srt THEN 1 + {N_HEADERS} ELSE 0 END AS n_syntax FROM kinds""",
    "roundtrip_differences": WITH.rstrip(", \n") + f" SELECT doc_id, 0 AS n_lost, 0 AS n_cue_no, count(*) FILTER ({ASS_MS.format('start_ms')} <> start_ms) AS n_start_ms, count(*) FILTER ({ASS_MS.format('end_ms')} <> end_ms) AS n_end_ms, 0 AS n_text FROM cues WHERE {ASS_MS.format('start_ms')} <> start_ms OR {ASS_MS.format('end_ms')} <> end_ms GROUP BY doc_id",
}
ORACLE_SQL |= {
    "check_documents_in_chunks": ORACLE_SQL["check_documents"],
    "overlap_pairs_in_chunks": ORACLE_SQL["overlap_pairs"],
    "normalize_documents_by_ranges": ORACLE_SQL["normalize_documents"],
    "syntax_errors_in_chunks": f"SELECT * FROM ({ORACLE_SQL['syntax_errors']}) WHERE format <> 'ass'",
    "decode_wide_text": """WITH wide AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN chr(65533) || text WHEN 2 THEN text || chr(65533) ELSE text END AS text, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS lone FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding, lone + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS bad_seq, length(text) - length(replace(text, chr(65533), '')) AS fffd, length(text) AS n_chars, sha256(text) AS text_sha256 FROM wide""",
}
