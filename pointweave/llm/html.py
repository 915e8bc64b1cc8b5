"""Main text of web pages by template deduction from equivalence classes of tokens of same-host pages.

A token is an element by its path (each step: name with class and id, digits as 0, and its place among equal siblings)
or a text by the path it stands at and its content. A token's occurrence vector over a host's pages is held as a linear
fingerprint, sum(count * hash(page)), so vectors are summed before the shuffle and a large host never meets in one task.

Three passes. Tokens with equal vectors that are on a fair share of the host's pages form a class (`classes`). A class is
valid where its tokens below one element have the same order on every page (`weights`); nesting is given by the paths,
and an element that encloses a valid group nests the group's class in its own. Valid elements are the template, texts in
the class of their own container are its fixed texts, and between both lie the slots, weighed by the text they hold over
all pages. `extract` goes down a page's template from the root, into the slot with most of the text, as long as there is
one, and keeps what that slot holds besides fixed texts. Roles (element names, class names) only clean slots and choose
among them: an element that holds the article is never dropped by its role."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, record_batch, slices, table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text rather than layout: the way down ends above them.
TEXTUAL = HEADING | frozenset("p ul ol li dl dt dd blockquote pre figure figcaption address details summary table".split())
DROP = frozenset("head nav header footer aside form menu dialog button select option".split())
#: Names of boilerplate. A class name of several words counts only if all are of this list or of QUALIFIER.
MARKED = frozenset("ad ads advert advertisement adverts sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar header footer masthead notice notices cookie cookies consent comment comments reply replies respond disqus form newsletter subscribe share sharing social related popup modal toolbar widget complementary contentinfo search".split())
QUALIFIER = frozenset("site page main global top bottom left right primary secondary list area box bar block section container wrapper wrap links buttons text inner outer form reader user bottom policy signup".split())
#: Roles that stay dropped even where they hold most of a page's text.
SURE = frozenset("head nav footer menu ad ads advert advertisement adverts cookie cookies comment comments reply replies respond disqus navbar navigation".split())
MAIN = frozenset(("article", "main"))
#: Least share of a host's pages, and least number of pages, that a class is on; the same for fixed texts, which are
#: kept if they are more than MOST of what a page's slot holds; hosts and entries of the model up to which it is broadcast.
SUPPORT, LEAST_PAGES, FIXED_SUPPORT, FIXED_PAGES, MOST = 0.2, 2, 0.5, 3, 0.5
BROADCAST_HOSTS, BROADCAST_TOKENS = 100_000, 1_000_000
_MASK = (1 << 64) - 1


def _named(attrs: str) -> tuple[str, set[str]]:
    """Class and id as one name, and the boilerplate roles they state."""
    name, roles = [], set()
    for _, a, b, c in ATTR.findall(attrs):
        value = (a or b or c).lower()
        name.append(DIGITS.sub("0", value))
        for one in value.split():
            words = [w for w in re.split(r"[^a-z]+", one) if w]
            if words and all(w in MARKED or w in QUALIFIER for w in words):
                roles.update(w for w in words if w in MARKED)
    return ".".join(name), roles


class Page:
    """Elements (0 is the root) with parent, tag, token and role, and the texts between them in page order."""

    def __init__(self, page: str):
        self.tag, self.up, self.token, self.drop = [""], [0], [0], [False]
        self.texts: list[tuple[int, str]] = []
        self.order: list[tuple[int, int]] = []  # (element, -1) where it opens, (element, n) for the n-th text
        self.sure: list[bool] = [False]
        seen: dict[tuple[int, str], int] = {}
        stack, words, at = [0], [], 0

        def flush():
            text = " ".join(unescape("".join(words)).split())
            words.clear()
            if text:
                self.order.append((stack[-1], len(self.texts)))
                self.texts.append((stack[-1], text))

        def close(tag):
            if any(self.tag[s] == tag for s in stack):
                while self.tag[stack.pop()] != tag:
                    pass

        def push(tag, name, roles):
            full = f"{tag}.{name}" if name else tag
            k = seen[stack[-1], full] = seen.get((stack[-1], full), 0) + 1
            self.tag.append(tag)
            self.up.append(stack[-1])
            self.token.append(xxhash.xxh64_intdigest(f"{full}[{k}]", self.token[stack[-1]]))
            self.drop.append(bool(roles) or tag in DROP)
            self.sure.append(bool(roles & SURE) or tag in SURE)
            stack.append(len(self.tag) - 1)
            self.order.append((stack[-1], -1))

        for m in TAG.finditer(page):
            words.append(page[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag in INLINE:
                if tag == "br":
                    words.append(" ")
                elif m[2]:
                    if any(self.tag[s] == tag for s in stack):
                        flush()
                        close(tag)
                elif m[4] and tag not in VOID and (named := _named(m[4]))[1]:  # a marked inline element is a block
                    flush()
                    push(tag, *named)
                continue
            flush()
            if m[2]:
                close(tag)
                continue
            if tag in VOID or m[4].endswith("/"):
                continue
            while self.tag[stack[-1]] == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.tag[stack[-1]] == tag:
                stack.pop()
            if tag == "body":
                close("head")
            push(tag, *(_named(m[4]) if m[4] else ("", set())))
            if tag in ("html", "body"):
                self.drop[-1] = False
        tail = page[at:]
        words.append(tail[: tail.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", tail) else tail)
        flush()
        self._roles()

    def _roles(self):
        """Roles that take effect: never that of an element that holds the page's only article, or, on pages without
        one, four fifths of the text, unless its role is sure."""
        n = len(self.tag)
        chars, dropped = [0] * n, self.drop[:]
        for k, t in self.texts:
            chars[k] += len(t)
        for k in range(n - 1, 0, -1):
            chars[self.up[k]] += chars[k]
        for k in range(1, n):
            dropped[k] = dropped[k] or dropped[self.up[k]]
        main = [k for k in range(n) if self.tag[k] in MAIN]
        if not any(not dropped[k] for k in main):
            whole = chars[0] - sum(chars[k] for k in range(n) if self.tag[k] == "head")
            best = max(main, key=chars.__getitem__, default=None)
            path = set()
            while best:
                path.add(best)
                best = self.up[best]
            for k in range(1, n):
                if self.drop[k] and not self.sure[k] and (k in path and 2 * chars[k] > whole or not main and 5 * chars[k] > 4 * whole):
                    self.drop[k] = False
            dropped = self.drop[:]
            for k in range(1, n):
                dropped[k] = dropped[k] or dropped[self.up[k]]
        below = [False] * n  # inside an article: a header's headings are the article's own
        for k in range(1, n):
            below[k] = below[self.up[k]] or self.tag[k] in MAIN
            if self.tag[k] in HEADING and below[k] and self.tag[self.up[k]] == "header" and dropped[k] and not self.drop[k] and not dropped[self.up[self.up[k]]]:
                dropped[k] = False
        self.dropped, self.chars = dropped, chars
        self.main = [k for k in main if not dropped[k]]

    def text_token(self, n: int) -> int:
        k, t = self.texts[n]
        return xxhash.xxh64_intdigest(t, self.token[k])

    def title(self) -> int:
        """Names the page's content: title, else first heading, else longest text."""
        for tags in (("title",), HEADING):
            for k, t in self.texts:
                if self.tag[k] in tags:
                    return _signed(xxhash.xxh64_intdigest(t))
        return _signed(xxhash.xxh64_intdigest(max((t for _, t in self.texts), key=len, default="")))


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def host_key(url: str | None) -> int:
    return _signed(xxhash.xxh64_intdigest(host_of(url)))


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, up, text, vector, pages, fixed): the tokens of each host's classes, `up` being the container.
    A token is on SUPPORT of the host's pages or more, once on each, and shares its vector with another token below
    the same container or with the container itself. A text is fixed if its container shares its vector and the pages
    differ in their titles (copies of a page aren't a template)."""
    names = ("host", "token", "up", "vector", "pages", "times", "lo", "hi")
    schema = pa.schema([("text", pa.bool_()), *((n, pa.int64()) for n in names)])

    def run(batches):
        total: dict = {}

        def rows():
            out = [(x, h, _signed(k), _signed(up), _signed(v[0]), *v[1:]) for (h, k, up, x), v in total.items()]
            total.clear()
            return record_batch(schema, list(zip(*out)) if out else [[]] * 9)

        for b in slices(batches):
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, host = Page(page or ""), host_key(url)
                h, title = xxhash.xxh64_intdigest((url or "") + "\0" + (page or "")), p.title()
                found = [(0, 0, False), *((p.token[k], p.token[p.up[k]], False) for k in range(1, len(p.tag)))]
                found += [(p.text_token(n), p.token[k], True) for n, (k, _) in enumerate(p.texts)]
                for k, up, text in found:
                    v = total.setdefault((host, k, up, text), [0, 0, 0, title, title])
                    v[0] = v[0] + h & _MASK
                    v[1] += 1
                    v[2] += 1
                    v[3], v[4] = min(v[3], title), max(v[4], title)
            if len(total) > 200_000:
                yield rows()
        yield rows()

    t = pages.select("url", "html").mapInArrow(run, "text boolean, " + ", ".join(f"{n} long" for n in names))
    # 64-bit sums wrap around, as the fingerprint wants: summed as two halves, so that ANSI mode does not object
    t = t.groupBy("host", "token", "up", "text").agg(F.sum(F.col("vector").bitwiseAND(0xFFFFFFFF)).alias("a"), F.sum(F.shiftright("vector", 32).bitwiseAND(0xFFFFFFFF)).alias("b"), F.sum("pages").alias("pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    high = F.pmod(F.col("b") + F.shiftright("a", 32), F.lit(1 << 32))
    t = t.withColumn("vector", F.xxhash64(high, F.col("a").bitwiseAND(0xFFFFFFFF))).drop("a", "b")
    t = cut(t.where(f"pages >= {LEAST_PAGES} or token = 0"))
    whole = t.where("token = 0").select("host", F.col("pages").alias("all"))
    t = t.where("token != 0").join(whole, "host").where((F.col("pages") >= F.lit(SUPPORT) * F.col("all")) & (F.col("pages") <= F.col("all")))
    box = t.where("not text").select("host", F.col("token").alias("up"), F.col("vector").alias("upper"))
    t = t.join(box, ["host", "up"], "left")
    fixed = F.col("text") & (F.col("upper") == F.col("vector")) & (F.col("lo") != F.col("hi")) & (F.col("pages") >= FIXED_PAGES) & (F.col("pages") >= F.lit(FIXED_SUPPORT) * F.col("all"))
    return t.where("not text or upper = vector").select("host", "token", "up", "text", "vector", "pages", F.coalesce(fixed, F.lit(False)).alias("fixed"))


class Model:
    """A host's part of the model: arrays by token, sorted."""

    def __init__(self, rows: dict[str, list]):
        order = np.argsort(np.array(rows["token"], np.int64), kind="stable")
        self.at = {int(np.int64(rows["token"][i])): n for n, i in enumerate(order)}
        for name, values in rows.items():
            setattr(self, name, [values[i] for i in order])


def _per_host(pages: DataFrame, model: DataFrame, columns: list[str], work, schema: pa.Schema, ddl: str, keep: list[str]) -> DataFrame:
    """Runs work(rows of `keep`, model of each row's host) over pages: the model is broadcast while it has few entries
    and joined by host beyond (a host's entries are bounded by its pages' size, not by how many they are; a host with
    very many pages is left to the adaptive skew split)."""
    per = model.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("m"))

    def of(m):
        return Model({c: [r[c] for r in m] for c in columns}) if m else None

    if model.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS and per.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        held = {r.host: of([x.asDict() for x in r.m]) for r in per.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            for b in slices(batches):
                cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
                for out in work((r, shared.value.get(host_key(r[0]))) for r in zip(*cols)):
                    yield record_batch(schema, out)

        return pages.select(*keep).mapInArrow(run, ddl)

    def joined(batches):
        for b in slices(batches):
            cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for out in work((r[:-1], of(r[-1])) for r in zip(*cols)):
                yield record_batch(schema, out)

    key = F.pandas_udf(lambda u: u.map(host_key), "long")
    return pages.withColumn("_host", key(F.coalesce("url", F.lit("")))).join(per.withColumnRenamed("host", "_host"), "_host", "left").select(*keep, "m").mapInArrow(joined, ddl)


def weights(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, token, fixed, chars): valid elements with the characters they hold on average (without fixed texts and
    roles) and fixed texts. A group, the tokens of one class below one element, is valid if they have one order on all
    pages. An element stays if its group is valid or if it encloses a valid group."""
    names = ("host", "key", "lo", "hi", "pages")
    schema = pa.schema([("order", pa.bool_()), *((n, pa.int64()) for n in names)])

    def work(rows):
        total: dict = {}
        for (url, page), m in rows:
            if m is None:
                continue
            p, host = Page(page or ""), host_key(url)
            n = len(p.tag)
            free, order = [0] * n, {}
            for k, i in p.order:
                token = _signed(p.token[k] if i < 0 else p.text_token(i))
                at = m.at.get(token)
                if at is not None:
                    group = m.group[at]
                    order[group] = xxhash.xxh64_intdigest(token.to_bytes(8, "little", signed=True), order.get(group, 0))
                if i >= 0 and not p.dropped[k] and (at is None or not m.fixed[at]):
                    free[k] += len(p.texts[i][1])
            for k in range(n - 1, 0, -1):
                free[p.up[k]] += free[k]
            for group, f in order.items():
                f = _signed(f)
                v = total.setdefault((True, host, group), [f, f, 0])
                v[0], v[1], v[2] = min(v[0], f), max(v[1], f), v[2] + 1
            for k in range(1, n):
                if (token := _signed(p.token[k])) in m.at:
                    v = total.setdefault((False, host, token), [0, 0, 0])
                    v[0] += free[k]
                    v[2] += 1
        out = [(*k, *v) for k, v in total.items()]
        if out:
            yield list(zip(*out))

    group = F.xxhash64("vector", "up")
    found = found.withColumn("group", group)
    ddl = "order boolean, " + ", ".join(f"{n} long" for n in names)
    t = _per_host(pages, found.select("host", "token", "group", "fixed"), ["token", "group", "fixed"], work, schema, ddl, ["url", "html"])
    t = cut(t.groupBy("order", "host", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.when(~F.col("order"), F.col("lo"))).alias("chars"), F.sum("pages").alias("pages")))
    good = t.where("order and lo = hi").select("host", F.col("key").alias("group"))
    held = t.where("not order").select("host", F.col("key").alias("token"), (F.col("chars") / F.col("pages")).alias("chars"))
    valid = found.join(good, ["host", "group"], "left_semi")
    box = found.where("not text")
    stays = valid.where("not text").select("host", "token").unionByName(valid.select("host", F.col("up").alias("token"))).distinct()
    boxes = box.join(stays, ["host", "token"], "left_semi").join(held, ["host", "token"]).select("host", "token", F.lit(False).alias("fixed"), "chars")
    return boxes.unionByName(valid.where("fixed").select("host", "token", "fixed", F.lit(0.0).alias("chars")))


def main_slot(p: Page, m: Model | None) -> list[int]:
    """The elements whose text is the page's main text: from the root down the template. Where a page marks its
    article, the way leads there; else into the slot with over half of its siblings' text, unless headings or a fifth
    of the text stand beside the slots."""
    holds = [False] * len(p.tag)
    for k in p.main:
        while k and not holds[k]:
            holds[k] = True
            k = p.up[k]
    kids: dict[int, list[int]] = {}
    for k in range(1, len(p.tag)):
        if not p.dropped[k]:
            kids.setdefault(p.up[k], []).append(k)
    at = 0
    while True:
        below = kids.get(at, [])
        lead = [k for k in below if holds[k]]
        if lead:
            if len(lead) > 1 or p.tag[lead[0]] == "article":
                return p.main if len(lead) > 1 else lead
            at = lead[0]
            continue
        if p.tag[at] in MAIN or m is None:
            return [at]
        slots = [k for k in below if p.tag[k] not in TEXTUAL and _signed(p.token[k]) in m.at]
        weight = [m.chars[m.at[_signed(p.token[k])]] for k in slots]
        beside = sum(p.chars[k] for k in below if k not in slots) + sum(len(t) for k, t in p.texts if k == at)
        if not slots or 2 * max(weight) <= sum(weight) or any(p.tag[k] in HEADING for k in below) or 5 * beside > p.chars[at]:
            return [at]
        at = slots[weight.index(max(weight))]


def main_text(page: str | None, m: Model | None) -> str:
    p = Page(page or "")
    roots = set(main_slot(p, m))
    inside, article = [k in roots for k in range(len(p.tag))], [t in MAIN for t in p.tag]
    for k in range(1, len(p.tag)):
        inside[k] = inside[k] or inside[p.up[k]]
        article[k] = article[k] or article[p.up[k]]
    kept = [n for n, (k, _) in enumerate(p.texts) if inside[k] and not p.dropped[k]]
    if m is not None:
        # prose of an article stays even where pages share it; its other fixed texts (a line of links, a button) go
        fixed = {n for n in kept if (at := m.at.get(_signed(p.text_token(n)))) is not None and m.fixed[at] and not (article[p.texts[n][0]] and p.tag[p.texts[n][0]] in TEXTUAL | MAIN)}
        if sum(len(p.texts[n][1]) for n in fixed) <= MOST * sum(len(p.texts[n][1]) for n in kept):
            kept = [n for n in kept if n not in fixed]
    return "\n".join(p.texts[n][1] for n in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row. Blocks are joined by line feeds. Null or empty html gives an empty
    text. A host's only page has no other to be compared with and goes by roles; a null or unreadable url is of the
    empty host; repeated rows stay; slots of equal weight: the first on the page."""
    model = cut(weights(pages, cut(classes(pages))))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(rows):
        out = []
        for (url, page, page_id), m in rows:
            t = main_text(page, m)
            out.append((page_id, url, t, len(t)))
        if out:
            yield list(zip(*out))

    rows = pages.select("url", "html", F.col("page_id").cast("long").alias("page_id"))
    return _per_host(rows, model, ["token", "fixed", "chars"], work, schema, "page_id long, url string, text string, n_chars long", ["url", "html", "page_id"])


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
