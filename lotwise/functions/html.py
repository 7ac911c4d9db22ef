"""HTML helpers as Column expressions.

Pages are read with regular expressions, not a DOM; attributes are double-quoted.
Elements found by class end at their own closing tag, whatever they hold.
"""
import re

from pyspark.sql import Column, functions as F

from lotwise.functions.text import strip

# fixed values: the character references that occur in listing pages
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when there is none or it is empty; the pattern runs once."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def plain(markup: Column, gap: str = "") -> Column:
    """Text without tags, references decoded, outer space removed."""
    out = F.regexp_replace(markup, r"(?s)<[^>]*>", gap)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return strip(out)


def _class_test(names) -> str:
    return r'class="(?:[^"]*\s)?(?:' + "|".join(re.escape(n) for n in names) + r')(?:\s[^"]*)?"'


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


NESTED = 3


def class_blocks(html: Column, *names: str) -> Column:
    """Inner markup of every element that has one of the classes, nested elements included.

    Where every such element is closed, and tags of its own name lie at most ``NESTED`` deep in
    it, one pattern reads them all.  Else the page is cut before every tag; from an opening tag on, tags of the same
    name are counted up and down until its own closing tag, or the end of the page.
    """
    loose, strict = (_class_test(names).replace('[^"]', f'[^"{more}]') for more in ("<", "<>"))
    # one letter of the name is enough here: more of them would be tried again from each letter
    openings = F.regexp_count(html, F.lit(rf"<\w[^<>]*?{loose}[^<>]*>"))
    body = r"[^<]*+(?:<(?!/?\1(?!\w))[^<]*+)*+"
    for _ in range(NESTED):
        body = rf"[^<]*+(?:<(?!/?\1(?!\w))[^<]*+|<\1(?!\w){body}</\1(?!\w)[^<]*+)*+"
    simple = all_of(html, rf"<(\w++)[^<>]*?{strict}[^<>]*>({body})</\1(?!\w)", 2)
    return bound(simple, lambda found_: F.when(F.size(found_) == openings, found_).otherwise(_counted_blocks(html, names)))


def _counted_blocks(html: Column, names) -> Column:
    """``class_blocks`` of any page, by counting tags."""
    opening = rf"^<\w+[^>]*{_class_test(names)}[^>]*>"

    def inner(page: Column, i: Column) -> Column:
        parts, tags = page["parts"], page["tags"]
        rest = F.slice(tags, i, F.size(tags))
        name = F.get(tags, i - 1)

        def step(s: Column, tag: Column) -> Column:
            depth = s["depth"] + F.when(tag == name, 1).when(tag == F.concat(F.lit("/"), name), -1).otherwise(0)
            return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n")))
        # the opening tag is counted beforehand
        walked = F.aggregate(F.slice(rest, 2, F.size(rest)), F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)
        kept = bound(walked, lambda w: F.array_join(F.slice(parts, i, F.when(w["depth"] == 0, w["n"]).otherwise(w["n"] + 1)), ""))
        return F.regexp_replace(kept, r"^<[^>]*>", "")

    def blocks(page: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(page["parts"])), lambda i: F.regexp_like(F.get(page["parts"], i - 1), F.lit(opening)))
        return F.transform(places, lambda i: inner(page, i))

    pages = bound(F.split(html, "(?=<)"), lambda parts: F.struct(parts.alias("parts"), F.transform(parts, lambda p: F.regexp_extract(p, r"^<(/?\w+)", 1)).alias("tags")))
    none = F.array().cast("array<string>")
    return F.when(html.rlike(_class_test(names)), bound(pages, blocks)).otherwise(F.when(html.isNotNull(), none))


def class_text(html: Column, *names: str) -> Column:
    return plain(F.try_element_at(class_blocks(html, *names), F.lit(1)))


def first_text(html: Column, *names: str) -> Column:
    """The first piece of text of the first element that has one of the classes, up to its first tag."""
    return plain(F.regexp_extract(F.try_element_at(class_blocks(html, *names), F.lit(1)), "^([^<]*)", 1))


def tag_text(html: Column, tag: str) -> Column:
    return plain(found(html, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"))


def attribute(tag: Column, name: str) -> Column:
    return found(tag, rf'\s{name}="([^"]*)"')


def hrefs(html: Column) -> Column:
    return all_of(html, r'<a\s[^>]*href="([^"]*)"')


def absolute(url: Column, base: Column) -> Column:
    """Joins a link to the scheme and host of its page."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    return F.when(url.rlike("^https?://"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), url)) \
        .when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(root, F.lit("/"), url))


def digits(text: Column) -> Column:
    """Integer of a digit group with spaces; NULL when anything else is left."""
    return F.regexp_replace(text, "[  ]", "").try_cast("int")
