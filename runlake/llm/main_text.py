"""Operator 12: main text of HTML pages by equivalence classes of template tokens.

Pages of one host are filled from one template. A page's tokens are its start tags and its
texts, each within its path of containers. Over the pages of a host

1. a token's occurrence vector is its count in every page; an exclusive or of hashes of
   (page, count) stands for it, so vectors of any length aggregate map-side, and tokens of
   one host with the same vector are one equivalence class. Classes that occur in at least
   ``SUPPORT`` of the pages, with more than one body of text, are kept;
2. the root class holds the tokens that every page has once; its tokens, by their place, cut
   a page into slots. Another class is valid if it has ``CLASS_SIZE`` tokens, they follow one
   another in one order in every page, and all lie in one slot of the root: such classes nest
   in the template. Pages are checked one by one, and the verdicts are summed up per class;
3. what is left in the slots is a page's own. The article is the page's article (or main)
   element, else the deepest container that holds ``SHARE`` of the host's own text; from it
   menus, notices, adverts, forms, comments and the like are left out by their element or its
   class, and outside an article element the blocks that are all template go too.

Large hosts are no groups: tokens, verdicts and containers are aggregated by (host, key), and
a host's template, at most ``1 / SUPPORT`` times the tokens of its mean page, joins its pages
(Spark broadcasts the templates by its own size check, and splits hot hosts in a sort-merge
join otherwise). Pages without a host have a template of their own, that is none.

Edge cases: a null or empty page has empty text; broken markup is read as browsers read it;
a page without an article element whose host's container is missing uses its own container;
copies of one page teach no template; repeated rows keep their own row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, identified, slices, stored
from runlake.llm.page_markup import Piece, parse
from runlake.llm.url_filter import url_parts

SUPPORT = 0.5
LEAST_PAGES = 3
CLASS_SIZE = 3
SHARE = 0.9
SKELETON = ("rid_file bigint, rid_row bigint, site string, body bigint, tokens array<bigint>, paths array<string>, chars array<int>, "
            "seen array<struct<token: bigint, n: int, first: int>>")
VERDICTS = "site string, cls bigint, path string, wrong bigint, low int, high int, chars bigint"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _token(p: Piece) -> int:
    return _hash(p.key if p.text is None else f"{p.path}|{' '.join(p.text.split())}")


def _prefixes(path: str) -> list[str]:
    at = [i for i, c in enumerate(path) if c == "/"][1:] + [len(path)]
    return [path[:i] for i in at]


def _skeleton(batches):
    for batch in slices(batches, "html"):
        out = []
        for rid_file, rid_row, site, page in zip(*(batch.column(i).to_pylist() for i in range(4))):
            pieces = [p for p in parse(page or "") if p.text is None or not p.text.isspace()]
            tokens = [_token(p) for p in pieces]
            seen: dict[int, list[int]] = {}
            for i, t in enumerate(tokens):
                if t in seen:
                    seen[t][0] += 1
                else:
                    seen[t] = [1, i]
            own = [p.text is not None and p.shown for p in pieces]
            out.append({"rid_file": rid_file, "rid_row": rid_row, "site": site if site is not None else f" {rid_file} {rid_row}",
                        "body": _hash(" ".join(p.text for p, o in zip(pieces, own) if o)), "tokens": tokens,
                        "paths": [p.path if o else "" for p, o in zip(pieces, own)],
                        "chars": [len(p.text) if o else 0 for p, o in zip(pieces, own)],
                        "seen": [{"token": t, "n": n, "first": f} for t, (n, f) in seen.items()]})
        yield pa.RecordBatch.from_pylist(out, _SKELETON_ARROW)


_SKELETON_ARROW = pa.schema([
    ("rid_file", pa.int64()), ("rid_row", pa.int64()), ("site", pa.string()), ("body", pa.int64()), ("tokens", pa.list_(pa.int64())),
    ("paths", pa.list_(pa.string())), ("chars", pa.list_(pa.int32())),
    ("seen", pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("first", pa.int32())])))])


def equivalence_classes(skeleton: DataFrame) -> DataFrame:
    """One row per site: ``classes``, an array of (token, cls, place, root)."""
    sites = skeleton.groupBy("site").agg(F.count("*").alias("of"))
    vectors = (skeleton.select("site", "body", F.explode("seen").alias("s"), F.xxhash64(*ROW_ID).alias("page"))
               .groupBy("site", F.col("s.token").alias("token"))
               .agg(F.count("*").alias("pages"), F.sum("s.n").alias("times"), F.avg("s.first").alias("place"),
                    F.bit_xor(F.xxhash64("page", "s.n")).alias("cls"), (F.min("body") != F.max("body")).alias("varied"))
               .filter((F.col("pages") >= LEAST_PAGES) & F.col("varied")))
    frequent = (vectors.join(sites, "site").filter(F.col("pages") >= SUPPORT * F.col("of"))
                .withColumn("root", (F.col("pages") == F.col("of")) & (F.col("times") == F.col("of"))))
    return frequent.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "token", "cls", "root"))).alias("classes"))


def _check(batches):
    """Per batch: of each (site, class) the pages that break its order, and the root slots it
    lies in; of each (site, container) the characters of its own text."""
    for batch in batches:
        verdicts: dict[tuple, list[int]] = {}
        chars: dict[tuple, int] = {}
        models: dict[str, dict] = {}
        for site, tokens, paths, sizes, classes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            known = models.get(site)
            if known is None:
                known = models[site] = {c["token"]: (c["cls"], i, c["root"]) for i, c in enumerate(classes or [])}
            slot, met = 0, {}
            for t, path, size in zip(tokens, paths, sizes):
                of = known.get(t)
                if of is not None:
                    slot += of[2]
                    met.setdefault(of[0], []).append((of[1], slot))
                if size and (of is None or not of[2]):
                    for prefix in _prefixes(path):
                        chars[site, prefix] = chars.get((site, prefix), 0) + size
            for cls, places in met.items():
                ranks = [r for r, _ in places]
                n = len(set(ranks))
                wrong = ranks != sorted(set(ranks)) * (len(ranks) // n)
                v = verdicts.setdefault((site, cls), [0, places[0][1], places[0][1]])
                v[0] += wrong
                v[1] = min(v[1], min(s for _, s in places))
                v[2] = max(v[2], max(s for _, s in places))
        rows = [(s, c, None, *v, None) for (s, c), v in verdicts.items()] + [(s, None, p, None, None, None, n) for (s, p), n in chars.items()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                         ["site", "cls", "path", "wrong", "low", "high", "chars"])


def templates(skeleton: DataFrame) -> DataFrame:
    """One row per site: ``template`` (tokens of the root and of the valid classes that nest in
    it: place, token, cls, root, slot) and ``container``, where the site's own text is."""
    classes = stored(equivalence_classes(skeleton), "page-classes")
    checked = stored(skeleton.select("site", "tokens", "paths", "chars").join(classes, "site", "left").mapInArrow(_check, VERDICTS)
                     .groupBy("site", "cls", "path").agg(F.sum("wrong").alias("wrong"), F.min("low").alias("low"),
                                                         F.max("high").alias("high"), F.sum("chars").alias("chars")), "page-verdicts")
    verdicts = checked.filter("cls IS NOT NULL").select("site", "cls", "wrong", "low", "high")
    tokens = classes.select("site", F.inline("classes"))
    sizes = tokens.groupBy("site", "cls").agg(F.count("*").alias("size"))
    valid = (tokens.join(verdicts, ["site", "cls"]).join(sizes, ["site", "cls"])
             .filter((F.col("wrong") == 0) & (F.col("root") | (F.col("low") == F.col("high")) & (F.col("size") >= CLASS_SIZE))))
    nested = valid.groupBy("site").agg(F.array_sort(F.collect_list(
        F.struct("place", "token", "cls", "root", F.col("low").alias("slot")))).alias("template"))
    paths = checked.filter("path IS NOT NULL")
    whole = paths.groupBy("site").agg(F.max("chars").alias("whole"))
    container = (paths.join(whole, "site").filter(F.col("chars") >= SHARE * F.col("whole"))
                 .groupBy("site").agg(F.max(F.struct(F.length("path").alias("depth"), "path")).alias("deepest"))
                 .select("site", F.col("deepest.path").alias("container")))
    return container.join(nested, "site", "full")


def _inside(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


def _own_container(pieces: list[Piece]) -> str:
    """The deepest container that holds ``SHARE`` of a page's shown text."""
    chars: dict[str, int] = {}
    for p in pieces:
        if p.text is not None and p.shown:
            for prefix in _prefixes(p.path):
                chars[prefix] = chars.get(prefix, 0) + len(p.text)
    most = max(chars.values(), default=0)
    return max((c for c, n in chars.items() if n >= SHARE * most), key=len, default="")


def extract(page: str, template: set[int], container: str | None) -> str:
    """Blocks of a page's main text, joined by line ends."""
    pieces = parse(page)
    texts = [p for p in pieces if p.text is not None and p.shown]
    article = "article" if any(p.article == "article" for p in texts) else "main" if any(p.article for p in texts) else ""
    if not article:
        own = {p.block for p in texts if not p.text.isspace() and _token(p) not in template}
        texts = [p for p in texts if p.block in own]  # blocks of which the template holds every text go
        if container is None or not any(_inside(p.path, container) for p in texts if not p.text.isspace()):
            container = _own_container(texts)
    blocks: dict[int, list[str]] = {}
    for p in texts:
        if p.article == "article" or article == "main" and p.article or not article and _inside(p.path, container):
            blocks.setdefault(p.block, []).append(unescape(p.text))
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(batches):
    for batch in slices(batches, "html"):
        held: dict[str, set[int]] = {}
        texts = []
        for site, page, container, template in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            known = held.get(site) if site is not None else set()
            if known is None:
                known = held[site] = {t["token"] for t in template or []}
            texts.append(extract(page or "", known, container))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    rows = identified(pages, id_col, url_col, html_col)
    rows = rows.select(*ROW_ID, F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    site = url_parts(F.coalesce(F.col("url"), F.lit("")))[0]
    rows = rows.withColumn("site", F.when(site != "", site))
    skeleton = stored(rows.select(*ROW_ID, "site", "html").mapInArrow(_skeleton, SKELETON), "page-skeletons")
    known = stored(templates(skeleton), "page-templates").filter("site NOT LIKE ' %'")
    id_type = rows.schema["page_id"].dataType.simpleString()
    return (rows.join(known, "site", "left").select("page_id", "url", "site", "html", "container", "template")
            .mapInArrow(_extract, f"page_id {id_type}, url string, text string"))
