"""Main text of web pages by the distribution of text over lines."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import text_batches

#: Lines of a window whose text is summed.
WINDOW = 3
#: Without an element that marks the article, a stretch counts if a window of it has so many characters, or as many as any.
LEAST_CHARS = 86
#: A line outside an article is a menu if links have this share of its characters.
LINK_SHARE = 0.7

#: Elements that don't end a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag whatever stands between.
RAW = "script|style|noscript|template|title|textarea|iframe|noembed|noframes|xmp"
#: Elements whose end tag may be left out; one that holds no article ends with the next line.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot colgroup html head body".split())
#: Elements that hold no article. A header is one unless it stands in an article, whose title it then holds.
ASIDE = frozenset("nav aside footer form menu dialog button select option svg canvas audio video object".split())
#: Elements that mark the article, the surer one higher.
MARKED = {"main": 1, "article": 2}
#: Words in class, id or role of an element that holds no article.
ASIDE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|masthead|site-header|page-header"
    r"|comments?|replies|respond|disqus|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|complementary|contentinfo|search)(?:$|[\s_-])"
)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+[^>]*(?:>.*?(?:</\1\b[^>]*>?|\Z)|\Z)|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+[^>]*)(?:>|\Z)|<[!?/][^>]*>?", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

LINE = "array<struct<text:string,chars:int>>"


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article) or HIDDEN.search(attributes):
        return True
    return name not in ("html", "body") and any(ASIDE_WORD.search("".join(m).lower()) for m in NAMED.findall(attributes))


def lines_of(page: str) -> tuple[list[dict], bool]:
    """The page's lines, one for each block: text, and chars, its characters but white space, 0 outside the article; whether an element marks it.

    Text in menus, forms, comments and the like stays as a line of 0 characters, so that a gap shows where it stood.
    """
    lines: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether in an aside, the article's mark, both with what is around
    text: list[str] = []
    linked = links = 0
    passing = False  # whether the line is an aside by itself

    def around() -> tuple[bool, int]:
        return stack[-1][1:] if stack else (False, 0)

    def close_line() -> None:
        nonlocal linked
        words = html.unescape("".join(text)).split()
        if words:
            chars = sum(map(len, words))
            aside, mark = around()
            lines.append((" ".join(words), 0 if aside or passing else chars, mark, linked >= LINK_SHARE * chars))
        text.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        piece = page[at : m.start()]
        if piece:
            text.append(piece)
            linked += sum(map(len, piece.split())) if links else 0
        at = m.end()
        ends, name, attributes = m.group(2), (m.group(3) or "").lower(), m.group(4) or ""
        if name == "a":
            links = max(0, links + (-1 if ends else 1))
        elif name == "br":
            text.append(" ")
        if not name or name in INLINE:
            continue
        close_line()
        aside, mark = around()
        passing = False
        if name in OPEN_ENDED:
            passing = not ends and _is_aside(name, attributes, mark > 0)
        elif ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # an end tag without its start doesn't end the article around it
            if depth is not None and (name in MARKED or not mark or (stack[depth - 1][2] if depth else 0)):
                del stack[depth:]
        elif name not in VOID and not attributes.endswith("/"):
            own = _is_aside(name, attributes, mark > 0)
            if name in MARKED and not own and not mark:
                stack.clear()  # an article ends what was left open before it
                aside = False
            stack.append((name, aside or own, max(mark, 0 if aside or own else MARKED.get(name, 0))))
    text.append(page[at:])
    close_line()
    best = max((mark for _, chars, mark, _ in lines if chars), default=0)
    # what interrupts a marked article is no gap
    if best:
        return [{"text": t, "chars": chars if mark == best else 0} for t, chars, mark, _ in lines if chars or mark < best], True
    return [{"text": t, "chars": 0 if menu else chars} for t, chars, _, menu in lines], False


def _stripped(pages: pd.Series) -> pd.DataFrame:
    found = [lines_of(p) for p in pages]
    return pd.DataFrame({"lines": [f[0] for f in found], "marked": [f[1] for f in found]})


def window_sums(lines: Column, window: int = WINDOW) -> Column:
    """For each line, the characters of it and the window - 1 lines after it."""
    chars = F.transform(lines, lambda x: x["chars"])
    return F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.aggregate(F.slice(chars, i, F.lit(window)), F.lit(0), lambda a, x: a + x))


def stretches(sums: Column) -> Column:
    """Structs (surge, dive, peak): where a window's sum leaves zero, where it is zero again (lines from 0), and the largest sum between."""
    empty = F.array().cast("array<struct<surge:int,dive:int,peak:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("since"), F.lit(0).alias("peak"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ends, begins = (x == 0) & (acc["since"] >= 0), (x > 0) & (acc["since"] < 0)
        done = F.array(F.struct(acc["since"].alias("surge"), acc["i"].alias("dive"), acc["peak"].alias("peak")))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(ends, F.lit(-1)).when(begins, acc["i"]).otherwise(acc["since"]).alias("since"),
            F.when(x == 0, F.lit(0)).otherwise(F.greatest(acc["peak"], x)).alias("peak"),
            F.when(ends, F.concat(acc["out"], done)).otherwise(acc["out"]).alias("out"),
        )

    # a zero after the last window ends what is open
    return F.aggregate(F.concat(sums, F.array(F.lit(0))), start, step, lambda acc: acc["out"])


def main_text(pages: DataFrame, window: int = WINDOW, least: int = LEAST_CHARS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Markup is stripped to lines, one for each block, with character references decoded and white space made one space. Lines of menus,
    page headers, footers, sidebars, notices, adverts, forms and comments, and all outside article or main where a page has one, weigh
    nothing. Sums over windows of lines surge where text begins and dive where window lines have none; the text between is kept, from
    its first line to its last, whole lines joined by a line end. Without article or main a stretch counts if one of its windows has
    least characters, or as many as any. A null or empty html has an empty text; long pages are taken whole; repeated rows give a row each; other columns
    are ignored, whatever their names; a table without rows gives none.
    """
    stripped = F.pandas_udf(_stripped, f"struct<lines:{LINE},marked:boolean>")
    rows = text_batches(pages).select("page_id", "url", stripped(F.coalesce("html", F.lit(""))).alias("_s"))
    rows = rows.select("page_id", "url", F.col("_s.lines").alias("_lines"), F.col("_s.marked").alias("_marked"))
    rows = rows.withColumn("_lines", F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("chars")))))
    rows = rows.withColumn("_all", stretches(window_sums(F.col("_lines"), window)))
    enough = F.least(F.lit(least), F.array_max(F.transform("_all", lambda s: s["peak"])))
    rows = rows.select("page_id", "url", "_lines", F.filter("_all", lambda s: F.col("_marked") | (s["peak"] >= enough)).alias("_kept"))
    # a window's sum leaves zero up to window - 1 lines before the text
    between = F.transform("_kept", lambda s: F.filter(F.slice("_lines", s["surge"] + 1, s["dive"] - s["surge"]), lambda x: x["chars"] > 0))
    text = F.array_join(F.transform(F.flatten(between), lambda x: x["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
