"""What a web page says: its visible text, the language that its markup declares, and host and suffix of its address.

Defined results: null html counts as empty; a tag or comment that never ends hides the rest; null or odd urls have neither
host nor suffix; a host that is a number or has no dot has no suffix; repeated rows give repeated results."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .url_filter import host_of

_TAG = re.compile(r"/?([a-z][a-z0-9-]*)", re.I)
_LANG = re.compile(r"""(?<![\w:-])lang\s*=\s*["']?\s*([A-Za-z]{2,8})""", re.I)
#: Elements whose content is not shown.
_HIDDEN = ("script", "style", "template", "noscript")


def page_text(source: str) -> tuple[str, str | None]:
    """(visible text, primary subtag of the declared language in lower case or None), in one pass over the tags."""
    first, *tags = source.split("<")
    out, language, hidden, comment = [first], None, None, False
    for tag in tags:
        if comment:
            comment = "-->" not in tag
            if not comment:
                out.append(tag.partition("-->")[2])
            continue
        name = _TAG.match(tag)
        name = name[0].lower() if name else ""
        if hidden:
            if name == "/" + hidden:
                hidden = None
                out.append(tag.partition(">")[2])
        elif tag.startswith("!--"):
            comment = "-->" not in tag[3:]
            out.append(tag[3:].partition("-->")[2])
        elif name or tag[:1] in ("!", "?", "/"):
            inside, _, rest = tag.partition(">")
            if name == "html" and language is None and (found := _LANG.search(inside)):
                language = found[1].lower()
            if name in _HIDDEN:
                hidden = name
            else:
                out += [" ", rest]
        else:
            out.append("<" + tag)
    text = "".join(out)
    return html.unescape(text) if "&" in text else text, language


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, text, declared, host, suffix of every row of pages."""

    def read(batches):
        for batch in batches:
            for first, sources in words.parts(batch.column(2), 4 << 20):
                got = [page_text(x or "") for x in sources.to_pylist()]
                texts, declared = (pa.array(c, pa.string()) for c in zip(*got))
                ids, hosts = (batch.column(c).slice(first, len(got)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, hosts, texts, declared], ["page_id", "host", "text", "declared"])

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = given.mapInArrow(read, "page_id long, host string, text string, declared string")
    suffix = F.regexp_extract("host", r"\.([a-z][a-z0-9-]*)$", 1)
    return rows.withColumn("suffix", F.when(suffix != "", suffix))
