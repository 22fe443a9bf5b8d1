"""Column functions on raw HTML: links and paragraphs, row by row, no shuffle."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsignal.functions.text import strip

# Parts of a page that hold no readable text.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
PARAGRAPH_OPEN = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_CLOSE = r"(?is)</p\s*>.*"
ENCLOSING_CLOSE = r"(?is)</(?:body|html|article|div|footer)\s*>.*"
TAG = r"(?s)<[A-Za-z/!?][^>]*>"
HREF = r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
# A list tag, or a whole link: up to its closing tag, the next link or the end.
LIST_TOKEN = r"(?is)</?(?:li|ul|ol)(?:\s[^>]*)?>|<a\s[^>]*>(?:(?!<a\s|</?(?:li|ul|ol)[\s>]).)*"
LINK_END = r"(?is)</a\s*>.*"

# The standard's names, with ; and, for the oldest ones, without.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
NUMBER = r"^&#(?:([0-9]+)|[xX]([0-9A-Fa-f]+));?"
NAME = r"^&([A-Za-z][A-Za-z0-9]*);"
BARE_NAME = "^&(" + "|".join(sorted(BARE, key=len, reverse=True)) + ")"


def _table(names: dict[str, str]) -> Column:
    """A constant map, written as one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{n}\x02{t}" for n, t in names.items())), F.lit("\x01"), F.lit("\x02"))


# Numbers 128 to 159 mean the characters of Windows-1252 where that has one.
WINDOWS = {
    str(n): text for n in range(128, 160) if (text := bytes([n]).decode("cp1252", "ignore"))
}


def _numbered(p: Column) -> Column:
    """The character of a numeric reference; NULL if there is none."""
    digits = F.regexp_replace(F.regexp_extract(p, NUMBER, 1), "^0+(?=.)", "")
    hexed = F.regexp_replace(F.regexp_extract(p, NUMBER, 2), "^0+(?=.)", "")
    code = F.when(digits != "", F.when(F.length(digits) <= 7, digits.try_cast("long"))).when(
        F.length(hexed) <= 6, F.conv(hexed, 16, 10).try_cast("long")
    )
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    plain = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(F.try_element_at(_table(WINDOWS), code.cast("string")), plain)


def decode(text: Column) -> Column:
    """Character references replaced, each once.

    Numbers may lack the semicolon, and so may the names that HTML allows it for;
    of those the longest is taken. Unknown references stay as they are.
    """

    def piece(p: Column) -> Column:
        name, bare = F.regexp_extract(p, NAME, 1), F.regexp_extract(p, BARE_NAME, 1)
        number = F.regexp_extract(p, NUMBER, 0)
        return F.coalesce(
            F.when(number != "", F.concat(_numbered(p), F.substr(p, F.length(number) + 1))),
            F.when(name != "", F.concat(F.try_element_at(_table(NAMED), name), F.substr(p, F.length(name) + 3))),
            F.when(bare != "", F.concat(F.try_element_at(_table(BARE), bare), F.substr(p, F.length(bare) + 2))),
            p,
        )

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def visible(fragment: Column) -> Column:
    """Text of a fragment: tags removed, references decoded, ends stripped."""
    return strip(decode(F.regexp_replace(fragment, TAG, "")))


def without_hidden(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "")


def _opened(html: Column, opening: str) -> Column:
    """What follows each opening tag, up to the next one."""
    pieces = F.split(without_hidden(html), opening)
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def paragraphs(html: Column) -> Column:
    """Texts of the <p> elements in page order. A new <p> closes the last one.

    A paragraph ends at its own closing tag, without one at that of the element around it.
    """

    def body(p: Column) -> Column:
        own = F.regexp_replace(p, PARAGRAPH_CLOSE, "")
        return F.when(p.rlike(PARAGRAPH_CLOSE), own).otherwise(F.regexp_replace(p, ENCLOSING_CLOSE, ""))

    return F.transform(_opened(html, PARAGRAPH_OPEN), lambda p: visible(body(p)))


def article_text(html: Column) -> Column:
    """Paragraph texts joined by one space."""
    return F.array_join(paragraphs(html), " ")


def links(html: Column) -> Column:
    """(text, url) of every link with an address inside a list item, in page order.

    One fold over the list tags and links of a page carries the open lists and
    items as a text of L and I. An item ends at its closing tag or with its list;
    </li> does not close an item outside of the innermost list. A link counts if
    any item around it is open, at any depth.
    """
    tokens = F.regexp_extract_all(without_hidden(html), F.lit(LIST_TOKEN), F.lit(0))
    nothing = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        is_link, closing = token.rlike(r"(?i)^<a\s"), token.startswith("</")
        is_item, open_now = token.rlike(r"(?i)^</?li"), state["open"]
        after = (
            F.when(is_link, open_now)
            .when(closing & is_item, F.regexp_replace(open_now, "I$", ""))
            .when(closing, F.regexp_replace(open_now, "LI*$", ""))
            .otherwise(F.concat(open_now, F.when(is_item, "I").otherwise("L")))
        )
        here = is_link & open_now.contains("I") & token.rlike(HREF)
        found = F.when(here, F.concat(state["found"], F.array(token))).otherwise(state["found"])
        return F.struct(after.alias("open"), found.alias("found"))

    anchors = F.aggregate(tokens, nothing, step)["found"]
    return F.transform(
        anchors,
        lambda a: F.struct(
            visible(F.regexp_replace(a, LINK_END, "")).alias("text"),
            F.concat(*[F.regexp_extract(a, HREF, i) for i in (1, 2, 3)]).alias("url"),
        ),
    )
