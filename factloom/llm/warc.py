"""WARC derivatives: linked metadata and plain-text conversion records of response records.

For each response two records are written: `metadata` (title, language, outlinks, the source's HTTP
headers, and its digests) and `conversion` (the page's text). Both carry WARC-Refers-To with the
response's record id, its target URI and date, and WARC-Refers-To-Payload-Digest; record ids are
version-5 UUIDs of the source's id, so a task that runs again writes the same records. A map: each
response is converted by itself, so nothing is shuffled.

Defined cases: a null URL or payload is empty; a payload without markup is its own text; responses
without a header block get an empty one; repeated responses give repeated derivatives; an empty
table gives an empty result; unclosed elements, comments and tags hide nothing. Every scan of a page is linear
in its length. Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import frugal, slices

CRLF = b"\r\n"
_HIDDEN = re.compile(r"(?i)<!--|<(script|style|noscript|template)\b")
_CLOSE = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "noscript", "template", "title")}
_BREAK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|blockquote|pre)\b[^>]*>")
_TAG = re.compile(r"<!?/?[A-Za-z!?][^>]*>")
_TITLE, _HTML, _ANCHOR = (re.compile(rf"(?i)<{k}\b") for k in ("title", "html", "a"))
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z0-9-]+)")
_HREF = re.compile(r"(?i)\bhref\s*=\s*")
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_SPACES = re.compile(r"[ \t\x0b\x0c\r\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


class _Ahead:
    """Where something next occurs in a page, asked at growing positions: the page is searched once."""

    def __init__(self, find):
        self.find, self.known = find, (-2, 0)

    def __call__(self, at: int):
        """(start, end) of the first occurrence from `at` on, or None."""
        if self.known is not None and self.known[0] < at:
            self.known = self.find(at)
        return self.known


def _ends(page: str) -> _Ahead:
    return _Ahead(lambda at: (i, i + 1) if (i := page.find(">", at)) >= 0 else None)


def _closings(page: str, kind: str) -> _Ahead:
    return _Ahead(lambda at: m.span() if (m := _CLOSE[kind].search(page, at)) else None)


def _without(page: str, opening: re.Pattern) -> str:
    """page with a space for each element (or comment) that opening begins and that is closed. The others stay."""
    end, close, comment = _ends(page), {}, _Ahead(lambda at: (i, i + 3) if (i := page.find("-->", at)) >= 0 else None)
    out, done, at = [], 0, 0
    while m := opening.search(page, at):
        at, kind = m.end(), (m[1] if m.re.groups else m[0][1:])
        if kind is None:
            last = comment(at)
        else:
            kind = kind.lower()
            tag = end(at)
            last = close.setdefault(kind, _closings(page, kind))(tag[1]) if tag else None
        if last:
            out += [page[done : m.start()], " "]
            done = at = last[1]
    return "".join([*out, page[done:]])


def _tags(pattern: re.Pattern, to: str, page: str) -> str:
    """pattern.sub(to, page) for patterns of tags: what follows the last > holds no whole tag."""
    end = page.rfind(">") + 1
    return pattern.sub(to, page[:end]) + page[end:]


def plain_text(page: str) -> str:
    """Text of a page, a line per block; scripts, styles and comments are left out. Linear in the page."""
    page = _without(_without(page, _HIDDEN), _TITLE)
    page = html.unescape(_tags(_TAG, "", _tags(_BREAK, "\n", page)))
    return _LINES.sub("\n", _SPACES.sub(" ", page)).strip()


def title_of(page: str) -> str:
    m = _TITLE.search(page)
    end = page.find(">", m.end()) if m else -1
    close = _CLOSE["title"].search(page, end + 1) if end >= 0 else None
    return html.unescape(page[end + 1 : close.start()]).strip() if close else ""


def language_of(page: str) -> str:
    """The language that the first tag <html> with one names, by its last attribute lang."""
    at = 0
    while m := _HTML.search(page, at):
        at = page.find(">", m.end())
        at = len(page) if at < 0 else at
        found = _LANG.findall(page[m.end() : at])
        if found:
            return found[-1]
    return ""


def links_of(page: str) -> list[str]:
    """Values of href of the tags <a>, by their last attribute of that name."""
    end, out, at = _ends(page), [], 0
    while m := _ANCHOR.search(page, at):
        last = end(m.end())
        at = last[0] if last else len(page)
        for attribute in reversed(list(_HREF.finditer(page, m.end(), at))):
            value = _VALUE.match(page, attribute.end())
            if value:
                out.append(html.unescape(next(filter(None, value.groups()), "")))
                at = max(value.end(), m.end())
                break
    return out


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; line breaks inside field values become spaces."""
    head = [b"WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, record binary"


def derivatives(responses: DataFrame, key_col: str, id_col: str, uri_col: str, date_col: str, headers_col: str, payload_col: str) -> DataFrame:
    """Two rows per response: its key, the record's type, ids and digests, and the record's bytes."""
    r = responses
    src = r.select(r[key_col].alias("key"), *(F.coalesce(r[c].cast("string"), F.lit("")).alias(n) for c, n in ((id_col, "rid"), (uri_col, "uri"), (date_col, "date"), (headers_col, "headers"), (payload_col, "payload"))))
    out = T.StructType([T.StructField(key_col, src.schema["key"].dataType), *T._parse_datatype_string(_SCHEMA).fields])

    def run(batches):
        for batch in batches:
            for b in slices(batch, "payload"):
                rows = []
                for rid, uri, date, headers, payload in zip(*(b.column(c).to_pylist() for c in ("rid", "uri", "date", "headers", "payload"))):
                    source = digest(payload.encode())
                    meta = [("source-status", headers.split("\r\n", 1)[0]), *(("source-header", h) for h in headers.split("\r\n")[1:] if h), ("title", title_of(payload)), ("language", language_of(payload)), *(("outlink", x) for x in links_of(payload))]
                    blocks = (("metadata", "application/warc-fields", CRLF.join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in meta) + CRLF), ("conversion", "text/plain; charset=utf-8", plain_text(payload).encode()))
                    for kind, mime, block in blocks:
                        new, own = record_id(rid, kind), digest(block)
                        fields = [("WARC-Type", kind), ("WARC-Record-ID", new), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Payload-Digest", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", own), ("Content-Type", mime)]
                        rows.append((kind, new, rid, uri, source, own, len(block), record(fields, block)))
                keys = b.column("key").take(pa.array([i for i in range(b.num_rows) for _ in range(2)], pa.int64()))
                kinds = (pa.string(),) * 6 + (pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=out.fieldNames())

    return src.mapInArrow(frugal(run), out)


def responses_of(pages: DataFrame, key_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages; ids follow from the key and the URL."""

    def hexes(c: Column, i: int, n: int) -> Column:
        return F.substring(c, i, n)

    size = F.octet_length(F.coalesce(F.col(html_col), F.lit("")))
    d = F.md5(F.concat_ws("|", F.col(key_col).cast("string"), F.coalesce(F.col(uri_col), F.lit(""))).cast("binary"))
    rid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", hexes(d, 1, 8), hexes(d, 9, 4), F.concat(F.lit("5"), hexes(d, 14, 3)), F.concat(F.lit("8"), hexes(d, 18, 3)), hexes(d, 21, 12)), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"))
    return pages.select(F.col(key_col), F.col(uri_col), rid.alias("record_id"), F.lit(date).alias("date"), headers.alias("headers"), F.col(html_col))
