"""Text expressions: normalised forms, tokens, lines, headings, article numbers, dates and decimals.

All are Column expressions, but for NFKC, which Spark lacks: it runs as an Arrow
UDF and only for texts with characters beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Token and phrase grammars.
ASCII_TOKEN = r"[a-z]+(?:/[a-z]+)?|[0-9]+(?:[.-][0-9]+)*"
CJK_RUN = "[㐀-鿿]+"
ARTICLE_NUMBER = r"(?<![0-9])(?:[0-9]+\.){2,3}[0-9]+(?:-[0-9]+)?(?![0-9])"
#: N-gram sizes of CJK runs.
GRAM_SIZES = (2, 4)
#: Characters at which lines end, as str.splitlines has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = r"(?U)\s"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII texts are their own and stay in the JVM."""
    return F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), _nfkc(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column, characters: str = r"\s") -> Column:
    """Without leading and trailing white space of any kind (or the regex class body given)."""
    return F.regexp_replace(text, f"(?U)^[{characters}]+|[{characters}]+$", "")


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, SPACE + "+", ""))


def bare(text: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\p{Punct}\p{IsPunctuation}]+", ""))


def search_form(text: Column, unicode_form: bool = True) -> Column:
    """NFKC, lower case, single spaces, none between CJK characters; null as empty."""
    value = F.coalesce(text, F.lit(""))
    value = squeeze(F.lower(nfkc(value) if unicode_form else value))
    return F.regexp_replace(value, "(?<=[㐀-鿿]) +(?=[㐀-鿿])", "")


def ascii_tokens(text: Column) -> Column:
    """Distinct words and numbers of a lower-cased text, in order of first place."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(ASCII_TOKEN), F.lit(0)))


def _grams(run: Column) -> Column:
    low, high = GRAM_SIZES
    sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(run)))
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, size))
    return F.when(F.length(run) >= low, F.concat(F.array(run), F.flatten(F.transform(sizes, cut)))).otherwise(F.array(run))


def tokens(text: Column, unicode_form: bool = True) -> Column:
    """Distinct ASCII words and numbers, then CJK runs each with its 2- to 4-grams."""
    value = search_form(text, unicode_form)
    runs = F.regexp_extract_all(value, F.lit(CJK_RUN), F.lit(0))
    return F.array_distinct(F.concat(F.regexp_extract_all(value, F.lit(ASCII_TOKEN), F.lit(0)), F.flatten(F.transform(runs, _grams))))


def cjk_phrases(text: Column) -> Column:
    """CJK runs of two characters or more."""
    return F.filter(F.regexp_extract_all(search_form(text), F.lit(CJK_RUN), F.lit(0)), lambda r: F.length(r) >= 2)


def lines_of(text: Column) -> Column:
    """Lines as str.splitlines has them: no empty line after a final line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def clean_page(text: Column) -> Column:
    """Lines with single spaces and no outer ones, single blank lines kept, none at the ends."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: strip(F.regexp_replace(x, "[ \t　]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "\n")


def standard_page(text: Column) -> Column:
    """NFKC text with plain spaces, colons and semicolons; the number of lines stays."""
    value = F.translate(nfkc(F.regexp_replace(text, "\r\n?", "\n")), " 　：；", "  :;")
    return F.array_join(F.transform(F.split(value, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n")


def is_page_number(line: Column) -> Column:
    """A line that is only a page number, plain, dashed or as 第 n 页."""
    return F.regexp_like(strip(line), F.lit("^(?:[-—–]? ?[0-9]{1,4} ?[-—–]?|第 ?[0-9]{1,4} ?页(?:/?共 ?[0-9]{1,4} ?页)?)$"))


def edge_form(line: Column) -> Column:
    """A header or footer for comparison: digits as #."""
    return F.regexp_replace(strip(line), "(?U)\\d+", "#")


def join_lines(lines: Column) -> Column:
    """Lines of one paragraph: list items start a line, CJK joins without a space, the rest with one."""
    item = "^(?:[0-9]+[ .、)]|[(（][0-9一二三四五六七八九十]+[)）])"

    def add(acc: Column, line: Column) -> Column:
        both_cjk = F.regexp_like(acc, F.lit("[　-鿿＀-￯]$")) | F.regexp_like(line, F.lit("^[　-鿿＀-￯]"))
        return F.when(acc == "", line).when(F.regexp_like(line, F.lit(item)), F.concat(acc, F.lit("\n"), line)).when(both_cjk, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(F.filter(lines, lambda x: x != ""), F.lit(""), add)


def decimal_text(value: Column) -> Column:
    """Canonical text of a decimal: no trailing zeros, no trailing point."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def iso_date(text: Column) -> Column:
    """The first Y-M-D date (with 年月日, dashes, points or slashes) as ISO text; null where it is no valid day."""
    year, month, day = (F.regexp_extract(text, r"((?:19|20)[0-9]{2}) ?[-./年] ?([0-9]{1,2}) ?[-./月] ?([0-9]{1,2})", g) for g in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd").cast("string")


#: The parts of a standard's code.
CODE = r"(?i)((?:GB|JGJ|CJJ|JTG|DBJ?)(?: ?/ ?T)?|T ?/ ?CECS) ?([0-9]+(?:\.[0-9]+)*) ?[-—–] ?([0-9]{4})"


#: All families that citations name, whole codes with a year first.
CITED = (
    r"(?iU)(?:(?:GB|JGJ|CJJ|JTG|DBJ?)(?:\s?/\s?T)?|T\s?/\s?CECS)\s?\d+(?:\.\d+)*\s?[-—–]\s?\d{4}(?!\d)"
    r"|(?:(?:GB|JGJ|CJJ|JTG|TB|JT)(?:/T)?|DL/T|DBJ|DB\d*(?:/T)?|(?:T\s?/\s?)?CECS)\s*[A-Z]*\s*\d[\d.\-—–/]*\d"
    r"|T\s*/\s*[A-Z0-9]+(?:\s*[-./]\s*[A-Z0-9]+)+|[A-Z]{2,}[A-Z0-9]*\s*-\s*[A-Z]{2,}[A-Z0-9]*(?:\s*-\s*[A-Z0-9]+)+"
)


def is_standard_code(code: Column) -> Column:
    """Whether a code in capitals without spaces is of a standard's family, and neither too short, too long, nor a UUID."""
    family = F.regexp_like(code, F.lit(r"^(?:GB|JGJ|CJJ|JTG|TB|JT|DL/T|DBJ|DB[0-9]*|CECS|T/)|^[A-Z]{2,}[A-Z0-9]*-[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9]+)+$"))
    uuid = F.regexp_like(code, F.lit("^[0-9A-F]{8}(?:-[0-9A-F]{4}){3}-[0-9A-F]{12}$"))
    return F.length(code).between(5, 48) & F.regexp_like(code, F.lit("[0-9]")) & family & ~uuid


def standard_codes(text: Column) -> Column:
    """All standard codes in order as PREFIXnumber-year in capitals without spaces; null where a match of CITED is no such code."""
    found = F.regexp_extract_all(text, F.lit(CITED), F.lit(0))
    plain = F.transform(found, lambda m: F.upper(F.regexp_replace(F.regexp_replace(m, r"(?U)\s+", ""), "[—–]", "-")))
    return F.transform(plain, lambda c: F.when(is_standard_code(c), c))


def standard_code(text: Column) -> Column:
    """The first standard code as PREFIXnumber-year in capitals without spaces; null without one."""
    return F.get(F.array_compact(standard_codes(text)), F.lit(0))


def masked(text: Column, pattern: str) -> Column:
    """The text with each match blanked by as many spaces, so that offsets stay."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blanks = F.concat(F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m))), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, blanks, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


#: Titles that need no number to be headings.
KNOWN_TITLES = (
    "工程概况", "编制依据", "编制说明及依据", "依据文件", "主要规范标准", "施工准备", "施工部署", "施工计划", "施工进度计划",
    "施工方法", "系统安装及施工", "施工工艺", "施工工艺技术", "安装施工", "专项施工方案", "施工技术", "施工方案",
    "质量保证措施", "质量标准", "安全保证措施", "施工安全保障措施", "安全防护措施", "文明施工", "职业健康安全", "环境保护",
    "应急预案", "成品保护", "计算书", "附图及计算书", "设计计算", "计算分析", "验算", "相关计算书",
)
#: Heading prefixes in order: (pattern, level or null for the number's depth, needs a known title).
HEADING_PREFIXES = (
    ("^第[一二三四五六七八九十百]+[章节篇]\\s*", 1, False),
    ("^[一二三四五六七八九十百]+、\\s*", 1, False),
    ("^[（(][一二三四五六七八九十百]+[）)]\\s*", 2, False),
    ("^[0-9]+、\\s*", 1, True),
    ("^[0-9]+[.．]\\s+", 1, True),
    ("^[0-9]+\\s+", 1, True),
    ("^[0-9]+(?:\\.[0-9]+)+(?:[、.．]\\s*|\\s+)", None, False),
)
#: What titles do not hold, start or end with.
TITLE_REJECTS = (
    "(?i)MPa|kPa|kN|N/mm|mm|cm|m²|m³|m3|%|℃|°|~|～",
    "(?i)^(?:GB(?:/T)?|JGJ(?:/T)?|JTG|CJJ|DBJ?) *[A-Z]* *[0-9][0-9.\\-/]*$",
    "^[）)、。，,；;~～]",
    "^(?:采用|应当|应(?!急)|必须|不得|严禁|设置|安装|使用|检查|确保)",
    "(?:。|\\.|，|,|；|;|：|:|…)$",
    "^[0-9.\\-~～/（）()]+$",
    "^(?=.*[0-9=<>≤≥×÷+*/^])[A-Za-zα-ωΑ-Ω0-9_{}()\\[\\].,+\\-*/=<>≤≥×÷^%：:]+$",
    "[=×÷].*[0-9]|[0-9].*[=×÷]",
)


def is_title(title: Column) -> Column:
    """Whether a text can be a heading's title: 2 to 30 characters and none of the rejects."""
    out = F.length(title).between(2, 30)
    for reject in TITLE_REJECTS:
        out = out & ~F.regexp_like(title, F.lit(reject))
    return out


def heading(line: Column, known_titles: tuple[str, ...] = KNOWN_TITLES, allow_plain: bool = True) -> Column:
    """struct(title, level) of a heading line, or null; prefixes are tried in order, the first that fits decides."""
    value = strip(line)
    chosen = F.lit(None).cast("struct<title:string,level:int>")
    known = lambda t: strip(t, " ：:。").isin(*known_titles)
    if allow_plain:
        chosen = F.when(known(value), F.struct(strip(value, " ：:。").alias("title"), F.lit(1).alias("level")))
    for pattern, level, needs_known in reversed(HEADING_PREFIXES):
        title = strip(F.regexp_replace(value, pattern, ""))
        depth = F.lit(level) if level else F.length(F.regexp_extract(value, "^([0-9.]*[0-9])", 1)) - F.length(F.replace(F.regexp_extract(value, "^([0-9.]*[0-9])", 1), F.lit("."), F.lit(""))) + 1
        found = F.struct(title.alias("title"), depth.cast("int").alias("level"))
        chosen = F.when(F.regexp_like(value, F.lit(pattern)), F.when(known(title), found) if needs_known else found).otherwise(chosen)
    fits = (value != "") & (F.length(value) <= 60) & ~F.regexp_like(value, F.lit("[：:]")) & is_title(chosen["title"])
    return F.when(fits, chosen)


#: Standard headings in order: (pattern, level); group 1 is the number, group 2 the title.
STANDARD_HEADINGS = (
    ("^第\\s*([0-9一二三四五六七八九十]+)\\s*章\\s*(.*)$", 1),
    ("(?i)^附录\\s*([A-Z])\\s*(.*)$", 1),
    ("(?i)^([A-Z]\\.[0-9]+)\\s+(.+)$", 2),
    ("^([0-9]+\\.[0-9]+)\\s+(.+)$", 2),
    ("^([0-9]+)\\s+(.+)$", 1),
)
CHINESE_DIGITS = "一二三四五六七八九"


def chinese_number(value: Column) -> Column:
    """Digits as they are; Chinese numerals up to ninety-nine as digits."""
    digit = lambda c: F.instr(F.lit(CHINESE_DIGITS), c)
    left, right = F.substring_index(value, "十", 1), F.substring_index(value, "十", -1)
    tens = F.when(left == "", 1).otherwise(digit(left)) * 10 + F.when(right == "", 0).otherwise(digit(right))
    return F.when(F.regexp_like(value, F.lit("^[0-9]+$")), value).when(F.contains(value, F.lit("十")), tens.cast("string")).when(digit(value) > 0, digit(value).cast("string")).otherwise(value)


def standard_heading(line: Column) -> Column:
    """struct(number, title, level) of a chapter, section, appendix or appendix section line, or null."""
    value = squeeze(line)
    out = F.lit(None).cast("struct<number:string,title:string,level:int>")
    for pattern, level in reversed(STANDARD_HEADINGS):
        number, title = F.upper(F.regexp_extract(value, pattern, 1)), strip(F.regexp_extract(value, pattern, 2))
        number = chinese_number(number) if "章" in pattern else number
        title = F.when(title == "", "附录").otherwise(title) if "附录" in pattern else title
        sentence = F.regexp_like(title, F.lit("应|不得|必须|严禁|可采用|规定")) if pattern.startswith("^([0-9]") else F.lit(False)
        out = F.when(F.regexp_like(value, F.lit(pattern)) & ~sentence, F.struct(number.alias("number"), title.alias("title"), F.lit(level).alias("level"))).otherwise(out)
    return F.when((value != "") & (F.length(value) <= 80) & ~F.regexp_like(value, F.lit("[。；;，,]$")), out)


#: Fixed value: the start of an article.
ARTICLE_START = r"(?i)^(?:第 ?)?((?:[0-9]+\.){2,3}[0-9]+(?:-[0-9]+)?|[A-Z]\.(?:[0-9]+\.)+[0-9]+(?:-[0-9]+)?) ?(?:条)? ?(.*)$"


def article_start(line: Column) -> Column:
    """struct(number, content) where a line opens an article, or null: no table, figure, formula, date, year or mere reference."""
    value = squeeze(line)
    number, content = F.upper(F.regexp_extract(value, ARTICLE_START, 1)), strip(F.regexp_extract(value, ARTICLE_START, 2))
    rejects = F.regexp_like(value, F.lit("(?i)^(?:表|图|公式) ?[A-Z]?[0-9]")) | F.regexp_like(value, F.lit(r"^(?:第 ?)?(?:[0-9]+\.){2,3}[0-9]+(?:-[0-9]+)?条(?:所列|规定|中|所述|要求)"))
    first = F.try_to_number(F.substring_index(number, ".", 1), F.lit("999999999"))
    year = F.coalesce(first >= 1900, F.lit(False))
    return F.when((number != "") & ~rejects & ~year, F.struct(number.alias("number"), content.alias("content")))


def number_prefix(longer: Column, shorter: Column) -> Column:
    """Whether the dotted number ``shorter`` is a proper prefix of ``longer``."""
    return F.startswith(longer, F.concat(shorter, F.lit(".")))
