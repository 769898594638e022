"""Structural blocks, chunks and opaque spans; stack-shaped text is read by one pass of a document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Size of a chunk, share at which a heading begins a new one, times at which a block is split.
TARGET, HEADING_FLOOR, FORCE = 6000, 0.6, 2
CAPTION_MOST = 400
STARTS = (("heading", re.compile(r"#{1,6}\s")), ("blockquote", re.compile(r">")), ("table", re.compile(r"\|")), ("list", re.compile(r"\s*(?:[-*+]|\d+[.)])\s")), ("image", re.compile(r"!\[[^\]]*\]\([^)]*\)\s*$")))
CAPTION = re.compile(r"^\W*(?:figure|fig\.|table|tab\.)\s*\d+", re.I)
FENCE = re.compile(r"\s*(`{3,}|~{3,})")
BEGIN = re.compile(r"\s*\\begin\{(\w+\*?)\}")
SPANS = (("M", r"\$\$.+?\$\$"), ("M", r"\\\[.+?\\\]"), ("M", r"\\\(.+?\\\)"), ("M", r"(?<![\\$])\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?!\d)"), ("C", r"\[@[^\]]+\]"))


def parse(text: str) -> list[tuple[str, str]]:
    """(kind, text) of every block, in order: fences and environments are closed before anything else counts."""
    out: list[tuple[str, str]] = []
    lines = text.split("\n")
    k = 0

    def run(kind: str, end: int) -> int:
        out.append((kind, "\n".join(lines[k:end])))
        return end

    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := FENCE.match(line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])), len(lines) - 1)
            k = run("code_block", end + 1)
        elif m := BEGIN.match(line):
            depth, end = 0, k
            for end in range(k, len(lines)):
                depth += lines[end].count("\\begin{" + m[1] + "}") - lines[end].count("\\end{" + m[1] + "}")
                if depth <= 0:
                    break
            k = run("latex_env", end + 1)
        else:
            kind = next((n for n, p in STARTS if p.match(line)), "paragraph")
            end = k + 1
            if kind == "paragraph":
                while end < len(lines) and lines[end].strip() and not FENCE.match(lines[end]) and not BEGIN.match(lines[end]) and not any(p.match(lines[end]) for _, p in STARTS):
                    end += 1
            elif kind not in ("heading", "image"):
                same = dict(STARTS)[kind]
                while end < len(lines) and lines[end].strip() and (same.match(lines[end]) or kind == "list"):
                    end += 1
            k = run(kind, end)
    return out


def weld(blocks: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """An image or table and the caption next to it are one figure."""
    out: list[tuple[str, str]] = []
    k = 0
    caption = lambda b: b[0] == "paragraph" and len(b[1]) <= CAPTION_MOST and bool(CAPTION.match(b[1]))
    while k < len(blocks):
        two = blocks[k : k + 2]
        if len(two) == 2 and ((two[0][0] in ("image", "table") and caption(two[1])) or (caption(two[0]) and two[1][0] in ("image", "table"))):
            out.append(("figure", two[0][1] + "\n\n" + two[1][1]))
            k += 2
        else:
            out.append(blocks[k])
            k += 1
    return out


def split(kind: str, text: str, target: int) -> Iterator[str]:
    """Pieces of a block that is too long, by blank lines, then by lines; what mustn't break stays whole."""
    if len(text) <= FORCE * target or kind in ("latex_env", "figure"):
        yield text
        return
    held = ""
    for part in (p for para in text.split("\n\n") for p in ([para] if len(para) <= target else para.split("\n"))):
        if held and len(held) + len(part) + 1 > target:
            yield held
            held = ""
        held = f"{held}\n{part}" if held else part
    if held.strip():
        yield held


def pack(blocks: list[tuple[str, str]], target: int = TARGET) -> list[str]:
    """Chunks: a block that would exceed the target begins a new one, a heading does at HEADING_FLOOR of it."""
    out, held, size = [], [], 0
    for kind, text in blocks:
        for piece in split(kind, text, target):
            if held and (size + len(piece) > target or (kind == "heading" and size >= HEADING_FLOOR * target)):
                out.append("\n\n".join(held))
                held, size = [], 0
            held.append(piece)
            size += len(piece) + 2
    return out + (["\n\n".join(held)] if held else [])


def protect(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with a token for each opaque span, and (token, span)."""
    spans: list[tuple[str, str]] = []

    def token(kind: str):
        def put(m: re.Match) -> str:
            spans.append((f"⟦{kind}{len(spans) + 1:04d}⟧", m[0]))
            return spans[-1][0]

        return put

    for kind, pattern in SPANS:
        text = re.sub(pattern, token(kind), text, flags=re.S)
    return text, spans


def restore(text: str, spans: list[tuple[str, str]], rounds: int = 8) -> str:
    """Tokens back to spans; spans may hold tokens themselves."""
    known = dict(spans)
    for _ in range(rounds):
        text, before = re.sub(r"⟦[A-Z]\d{4,}⟧", lambda m: known.get(m[0], m[0]), text), text
        if text == before:
            break
    return text


def protected(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with tokens, its spans (token, span) and what restoring gives; a null text is null throughout."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {key: [], "text": [], "spans": [], "restored": []}
            for i, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                held, spans = protect(t) if t is not None else (None, [])
                out[key].append(i)
                out["text"].append(held)
                out["spans"].append([{"token": a, "span": z} for a, z in spans])
                out["restored"].append(None if held is None else restore(held, spans))
            span = pa.struct([("token", pa.string()), ("span", pa.string())])
            yield pa.RecordBatch.from_pydict(out, pa.schema([(key, pa.int64()), ("text", pa.string()), ("spans", pa.list_(span)), ("restored", pa.string())]))

    return docs.select(key, text).mapInArrow(run, f"{key} long, text string, spans array<struct<token: string, span: string>>, restored string")


def split_rows(body: str) -> list[str]:
    r"""Rows of a LaTeX table: `\\` counts outside braces and environments only."""
    rows, depth, envs, start, k = [], 0, 0, 0, 0
    while k < len(body):
        c = body[k]
        if c == "\\":
            if body.startswith("\\begin{", k):
                envs += 1
            elif body.startswith("\\end{", k):
                envs -= 1
            elif body.startswith("\\\\", k):
                if not depth and not envs:
                    rows.append(body[start:k])
                    start = k + 2
            k += 2
            continue
        depth = max(0, depth + (c == "{") - (c == "}"))  # a brace that closes nothing counts for nothing
        k += 1
    return [r for r in (*rows, body[start:]) if r.strip()]


def page_numbers(lines: list[str]) -> set[int]:
    """Places of digit-only lines on the longest run that never falls, if it has at least 4 and half of them."""
    import bisect

    at = [(k, int(x)) for k, x in enumerate(lines) if re.fullmatch(r"\s*\d{1,9}\s*", x)]
    tails: list[int] = []
    where: list[int] = []
    back: list[int] = []
    for j, (_, v) in enumerate(at):
        k = bisect.bisect_right(tails, v)
        back.append(where[k - 1] if k else -1)
        tails[k:], where[k:] = ([v], [j]) if k == len(tails) else ([v, *tails[k + 1 :]], [j, *where[k + 1 :]])
    chain, j = set(), where[-1] if where else -1
    while j >= 0:
        chain.add(at[j][0])
        j = back[j]
    return chain if len(chain) >= 4 and 2 * len(chain) >= len(at) else set()


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET) -> DataFrame:
    """key, chunk_no, text: every document parsed, welded and packed by itself; nothing is shuffled."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {key: [], "chunk_no": [], "text": []}
            for i, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                for n, c in enumerate(pack(weld(parse(t or "")), target)):
                    out[key].append(i)
                    out["chunk_no"].append(n)
                    out["text"].append(c)
            yield pa.RecordBatch.from_pydict(out, pa.schema([(key, pa.int64()), ("chunk_no", pa.int64()), ("text", pa.string())]))

    return docs.select(key, text).mapInArrow(run, f"{key} long, chunk_no long, text string")
