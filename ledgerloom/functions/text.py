"""Scalar functions over text, dates and numbers; every one is a built-in column expression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Characters that decompose to one bare character and that character, then the combining marks, which go.

    Built by rule from canonical decomposition, over all scripts but Hangul syllables.
    """
    bare, marks = {}, []
    for x in [*range(0xC0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]:
        c = chr(x)
        kept = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
        if not kept:
            marks.append(c)
        elif len(kept) == 1 and kept[0] != c:
            bare[c] = kept[0]
    return "".join(bare) + "".join(marks), "".join(bare.values())


ACCENTED, BARE = _accent_table()
FOLDED = {ord(x): y for x, y in zip(ACCENTED, BARE, strict=False)} | {ord(x): None for x in ACCENTED[len(BARE) :]}
WHITE = "[\\s\\u00A0]+"


def fold_text(c: Column) -> Column:
    """Lower case without accents; null gives ''."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), ACCENTED, BARE))


def fold_literal(text: str) -> str:
    return text.translate(FOLDED).lower()


# Fixed value: a term is a word where neither a letter nor a digit is next to it.
WHOLE_WORD = "(?<![a-z0-9]){}(?![a-z0-9])"


def contains_term(c: Column, term: str) -> Column:
    """Whole-word match on folded text; a blank term never matches."""
    folded = fold_literal(term).strip()
    return fold_text(c).rlike(WHOLE_WORD.format(re.escape(folded))) if folded else F.lit(False)


def normalize_key(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " ")))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def parse_local_ts(c: Column, tz: str, now: Column) -> Column:
    """d/M/y H:m or d/M/y in a local zone as UTC; years before 2000 or over two ahead of ``now`` give null."""
    parsed = F.coalesce(F.try_to_timestamp(c, F.lit("d/M/yyyy H:m")), F.try_to_timestamp(c, F.lit("d/M/yyyy")))
    return F.when((F.year(parsed) >= 2000) & (F.year(parsed) <= F.year(now) + 2), F.to_utc_timestamp(parsed, tz))


def parse_ddmmyy(c: Column) -> Column:
    """d/M/yy (69 to 99 are of the last century), else d/M/yyyy."""
    short = F.try_to_timestamp(c, F.lit("d/M/yy")).cast("date")
    pivoted = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(pivoted, F.try_to_timestamp(c, F.lit("d/M/yyyy")).cast("date"))


def default_since(day: Column) -> Column:
    return F.add_months(day, -12)


def parse_prefix_ts(c: Column) -> Column:
    """Time stamp at the start of a text, dd/mm/yyyy[ hh:mm[:ss]]; impossible dates give null."""
    part = lambda n: F.nullif(F.regexp_extract(c, r"^(\d{2})/(\d{2})/(\d{4})(?: (\d{2}):(\d{2})(?::(\d{2}))?)?", n), F.lit(""))
    number = lambda n, other=None: part(n).cast("int") if other is None else F.coalesce(part(n).cast("int"), F.lit(other))
    return F.try_make_timestamp(number(3), number(2), number(1), number(4, 0), number(5, 0), number(6, 0).cast("double"))


def int_or_zero(c: Column) -> Column:
    """The digits of a text as one number, whatever stands between them; 0 without any, and for numbers beyond 64 bits."""
    return F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("bigint"), F.lit(0))


NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def float_or_zero(c: Column) -> Column:
    """A decimal number without its commas; ``nan`` and ``inf`` are numbers, a type's letter after the digits makes none."""
    text = F.lower(F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(",")))
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_")).try_cast("double"))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    odd = F.when(text.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(text.rlike(r"^[+-]?inf(inity)?$"), sign * F.lit(float("inf")))
    return F.coalesce(number, odd, F.lit(0.0))


def nid_int(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint")), F.lit(-1))


def nid_advances(current: Column, new: Column) -> Column:
    """A numeric identity replaces one that is not numeric or is smaller, never the reverse."""
    return (nid_int(new) >= 0) & (nid_int(new) > nid_int(current))


def extract_year(code: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, r"20\d{2}", 0), F.lit("")).cast("int"), default)


def remove_phrases(c: Column, phrases: Sequence[str]) -> Column:
    """Phrases out, whatever their case, and white space collapsed."""
    for phrase in phrases:
        c = F.regexp_replace(c, f"(?iu){re.escape(phrase)}", "")
    return F.trim(F.regexp_replace(c, WHITE, " "))


def url_param(url: Column, name: str) -> Column:
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1), F.lit("")))


# Characters that a file name may not hold, the form of a size and of a uuid, the longest name.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'
SIZE_LABEL = r"(?i)^\(?\s*\d+(?:\.\d+)?\s*(?:KB|MB|GB|B)\s*\)?$"
UUID_STEM = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LONGEST_NAME = 180
EXTENSION = r"(?s)^.+(\.[^.]+)$"


def base_name(c: Column) -> Column:
    """What follows the last slash of either kind; slashes at the end do not count."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), "/+$", "")
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """The last dot and what follows; '' without one, or if nothing is before or after it."""
    return F.regexp_extract(name, EXTENSION, 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def sanitize_filename(c: Column, fallback: Column | str = "documento") -> Column:
    """Last path part with forbidden characters as ``_`` and single blanks; its extension (default .pdf) survives the cut to 180 characters."""
    name = F.regexp_replace(F.trim(base_name(c)), FORBIDDEN, "_")
    name = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    name = F.when(name == "", F.lit(fallback) if isinstance(fallback, str) else fallback).otherwise(name)
    kind = extension(name)
    kind = F.when(kind == "", F.lit(".pdf")).otherwise(kind)
    return F.concat(F.substring(stem(name), F.lit(1), F.lit(LONGEST_NAME) - F.length(kind)), kind)


def looks_like_uuid(c: Column, uuid: Column | None = None) -> Column:
    """Whether a file's name without extension is a uuid, or the given one."""
    own = stem(base_name(c))
    like = own.rlike(UUID_STEM)
    return like if uuid is None else like | F.coalesce((uuid != "") & (F.lower(own) == F.lower(uuid)), F.lit(False))


def looks_like_size_label(c: Column) -> Column:
    """Whether a file's name, without .pdf, is a size such as (12.5 KB)."""
    return F.regexp_replace(base_name(F.trim(c)), r"(?i)(?<=.)\.pdf$", "").rlike(SIZE_LABEL)


def score_name(c: Column, must: str, bonus: dict[str, int]) -> Column:
    """-1 without the keyword, else 20 plus what each further word adds."""
    folded = fold_text(c)
    total = F.lit(20)
    for word, points in bonus.items():
        total = total + F.when(folded.contains(word), points).otherwise(0)
    return F.when(folded.contains(must), total).otherwise(-1)


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))


def rewrite(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


# Ordered rewrites of recognised text.
OCR_RULES = [(r"(?s)<::.*?::>", ""), (r"\x00", "°"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+\z", "")]
LIGATURE_RULES = [
    ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb00", "ff"), ("\ufb03", "ffi"), ("\ufb04", "ffl"),
    (r"\\times", "×"), (r"\^\{(\d+)\}", "^$1"), (r"\\\(\s*([^)]+?)\s*\\\)", "$1"),
    (r"\^\{\\circ\}", "°"), (r"N\^\{circ\}", "N°"), (r"\^\{circ\}", "°"),
]
SPACING_RULES = [
    (r"([a-záéíóúñ])\.\s*(\d+\.\d+\.\s)", "$1.\n\n$2"), (r"([a-záéíóúñ])\.\s*(\d+\.\s)", "$1.\n\n$2"),
    (r"([A-ZÁÉÍÓÚÑ]{2,})([A-ZÁÉÍÓÚÑ][a-záéíóúñ])", "$1\n\n$2"), (r"([^\n#])(#{1,6}\s)", "$1\n\n$2"),
    (r"\s+\d{1,2}\s+(LICITACIÓN|CONTRATACIÓN|ADJUDICACIÓN|BASES|DISPOSICIONES|CAPÍTULO|SECCIÓN|ANEXO)", "\n\n$1"), (r"\n{3,}", "\n\n"),
]


def clean_ocr_text(c: Column) -> Column:
    """Annotation blocks out, NULs as degree signs, at most one blank line, trimmed."""
    return rewrite(c, OCR_RULES)


def fix_ligatures(c: Column) -> Column:
    """Ligatures spelled out and formula marks unwrapped."""
    return rewrite(c, LIGATURE_RULES)


def fix_spacing(c: Column) -> Column:
    """Line breaks where headings, sentences and numbers were glued together."""
    return rewrite(c, SPACING_RULES)


CLUSTER_RULES = [(r"\s+", " "), (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", "DATE"), (r"[0-9]{1,2}:[0-9]{2}", "TIME"), (r"[0-9]{1,4}", "N")]


def normalize_for_clustering(c: Column) -> Column:
    """Dates, times and numbers made alike, in that order."""
    return F.trim(rewrite(c, CLUSTER_RULES))


# Words that mark a page number, what must stand after them, and the word before the number of pages.
PAGE_MARKS = (("p[aá]gina", r"\s+", "de"), ("p[aá]g\\.?", r"\s*", "de"), ("page", r"\s+", "of"), ("hoja", r"\s+", "de"), ("sheet", r"\s+", "of"))
AROUND_MARK = r"[-–—\s]*"


def is_page_number(c: Column) -> Column:
    """A mark with its number, and perhaps the number of pages, between dashes or blanks; a number alone is none."""
    forms = "|".join(rf"{mark}{gap}\d+(\s+{of}\s+\d+)?" for mark, gap, of in PAGE_MARKS)
    return F.coalesce(c.rlike(f"(?iU)^{AROUND_MARK}({forms}){AROUND_MARK}$"), F.lit(False))


def slugify(c: Column, n: int = 60) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.substring(F.regexp_replace(F.when(slug == "", "item").otherwise(slug), " ", "_"), 1, n)


def format_ts(c: Column, tz: str) -> Column:
    """ISO text as local dd/MM/yyyy HH:mm; what cannot be read stays."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(c), tz), "dd/MM/yyyy HH:mm"), c)


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def canonical(rows: Column, fields: Sequence[str]) -> Column:
    """A list of structs as one text: trimmed fields, blanks for nulls."""
    field = lambda r, f: F.trim(F.coalesce(r[f].cast("string"), F.lit("")))
    return F.coalesce(F.array_join(F.transform(rows, lambda r: F.concat_ws("\u0001", *[field(r, f) for f in fields])), "\u0002"), F.lit(""))


def content_hash(schedule: Column, stages: Sequence[str], documents: Column, fields: Sequence[str], date: Column) -> Column:
    """Digest of an item's schedule and documents, as listed, and its date."""
    return row_hash(canonical(schedule, stages), canonical(documents, fields), date)


def by_id(documents: Column, uuid: str) -> Column:
    """Documents with an id, in the order of their ids."""
    known = F.filter(documents, lambda d: F.trim(F.coalesce(d[uuid].cast("string"), F.lit(""))) != "")
    order = lambda a, b: F.when(a[uuid] < b[uuid], -1).when(a[uuid] > b[uuid], 1).otherwise(0)
    return F.array_sort(known, order)


def docs_fingerprint(documents: Column, uuid: str, fields: Sequence[str]) -> Column:
    """Digest of the documents that have an id, whatever their order."""
    return row_hash(canonical(by_id(documents, uuid), [uuid, *fields]))


def watch_fingerprint(schedule: Column, stage: str, dates: Sequence[str], noise: Sequence[str], documents: Column, uuid: str, fields: Sequence[str], date: Column) -> Column:
    """Digest that noise in stage names, the order of documents, documents without an id and blanks around values do not change."""
    cleaned = F.transform(schedule, lambda r: F.struct(remove_phrases(r[stage], noise).alias(stage), *[r[d].alias(d) for d in dates]))
    return row_hash(canonical(cleaned, [stage, *dates]), canonical(by_id(documents, uuid), [uuid, *fields]), F.trim(date))


def hard_soft(c: Column, hard: Sequence[str], soft: Sequence[str]) -> Column:
    """Soft wording is looked for first; the default is Hard only with a hard word or a quantity."""
    folded = fold_text(c)
    any_of = lambda words: folded.rlike("|".join(map(re.escape, words)))
    return F.when(any_of(soft), "Soft").when(any_of(hard) | folded.rlike("[0-9]"), "Hard").otherwise("Soft")


def keyword_score(c: Column, words: Sequence[str]) -> Column:
    folded, total = fold_text(c), F.lit(0)
    for w in words:
        total = total + folded.contains(fold_literal(w)).cast("int")
    return total


# Words that open a chatter line, and the heading of an appended schedule.
CHATTER = r"(?iu)\A\s*(?:\s*(?:claro|aquí tienes|a continuación|como solicitaste|a continuación te presento)[^\n]*\n)+"
RULES = r"\A\s*(?:(?:\*\*\*|---|___)[^\n]*(?:\n\s*|\z))*"
SCHEDULE_MARK = "## Cronograma (ficha SEACE"


def strip_preamble(c: Column) -> Column:
    """Without leading chatter lines and rules."""
    return F.regexp_replace(F.regexp_replace(c, CHATTER, ""), RULES, "")


def strip_marker_section(c: Column, mark: str = SCHEDULE_MARK) -> Column:
    """Cut at the mark, and trimmed there; text without it stays as it is."""
    return F.when(F.contains(c, F.lit(mark)), F.regexp_replace(F.substring_index(c, mark, 1), r"\s+\z", "")).otherwise(c)


def doc_label(kind: Column, stage: Column, uuid: Column) -> Column:
    kind, stage = F.nullif(F.trim(kind), F.lit("")), F.nullif(F.trim(stage), F.lit(""))
    return F.when(kind.isNotNull() & stage.isNotNull(), F.concat(stage, F.lit(" · "), kind)).otherwise(F.coalesce(stage, kind, F.substring(uuid, 1, 8)))


def diff_risk(share: Column, largest: Column, regions: Column) -> Column:
    """Risk of a page by its changed share, the share of the largest changed region and the number of regions."""
    # The thresholds.
    return F.when((share >= 0.20) | (largest >= 0.12), "high").when((share >= 0.05) | (largest >= 0.03) | (regions >= 20), "medium").when((share >= 0.005) | (regions > 0), "low").otherwise("none")


def valid_bbox(box: Column) -> Column:
    """Four finite shares of the page, at least 0.01 wide and high, at most 0.70 of its area."""
    w, h = box[2] - box[0], box[3] - box[1]
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return F.coalesce((F.size(box) == 4) & finite & (w >= 0.01) & (h >= 0.01) & (w * h <= 0.70), F.lit(False))


def parse_json_list(c: Column, fields: Sequence[str] | Mapping[str, str]) -> Column:
    """Objects of a JSON list as structs of trimmed strings; anything else in it goes, bad text and other JSON give [].

    ``fields`` may give each key the default that stands for it where it is missing or null, else the empty text.
    """
    defaults = dict(fields) if isinstance(fields, Mapping) else dict.fromkeys(fields, "")
    parsed = F.try_parse_json(c)
    items = F.coalesce(F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed).cast("array<variant>"), F.array().cast("array<variant>"))
    text = lambda x, f: F.trim(F.coalesce(F.try_variant_get(x, f"$['{f}']", "string"), F.lit(defaults[f])))
    objects = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    return F.transform(objects, lambda x: F.struct(*[text(x, f).alias(f) for f in defaults]))
