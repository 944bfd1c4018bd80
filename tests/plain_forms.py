"""Rules that the library states as SQL folds, as plain Python over one group at a time, for tests to hold them against."""

import csv
import io
import re

from corpusframe.operators.chunking import LEAST, MOST, TARGET
from corpusframe.operators.evidence import TITLE

OVERLAP = 1  # blocks


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def looks_like_heading(text: str) -> bool:
    """The column function ``is_heading`` for one text that is clean already."""
    if not text or len(text) > 90 or (text.endswith(".") and len(text) > 25):
        return False
    if (text.upper() == text and re.search(r"[^\W\d_]", text) and len(text) <= 60) or (text.endswith(":") and len(text) <= 70):
        return True
    words = text.split()
    return len(words) <= 8 and sum(w[0].isalpha() for w in words) >= max(1, len(words) - 1) and not re.match("(table|figure|fig) ", text.lower())


class _Open:
    """The chunk that is being filled."""

    def __init__(self, drop_overlap_tail: bool):
        self.blocks, self.fresh, self.heading, self.out, self.drop = [], 0, None, [], drop_overlap_tail

    def text(self) -> str:
        return "\n\n".join(b["text"] for b in self.blocks)

    def close(self, overlap: int = OVERLAP, final: bool = False) -> None:
        if self.blocks and not (final and self.drop and not self.fresh):
            first, last = self.blocks[0], self.blocks[-1]
            self.out.append({"page_start": first["page"], "page_end": last["page"], "section_heading": self.heading, "locator": first["locator"], "block_ids": [b["block_id"] for b in self.blocks], "text": self.text()})
        self.blocks, self.fresh = (self.blocks[-overlap:] if overlap else []), 0

    def add(self, block: dict) -> None:
        self.blocks.append(block)
        self.fresh += 1


def chunk_blocks(blocks: list[dict], drop_overlap_tail: bool = False, compat: bool = False) -> list[dict]:
    """Chunks of one document's blocks in reading order.

    A heading closes a chunk of ``LEAST`` tokens or more and heads the next; its own text is in no chunk. A chunk closes
    at ``MOST`` tokens, and at ``TARGET`` where a heading, a boundary or another page follows; its last block begins the
    next one. Blocks marked ``force_chunk`` stand alone. At the end what is open becomes a chunk, even if only the
    overlap is left, unless ``drop_overlap_tail``. ``compat`` ignores the marks that parsers set.
    """
    state = _Open(drop_overlap_tail)
    rows = [dict(b, text=t) for b in blocks if (t := re.sub(r"[\s\x00]+", " ", b["text"] or "").strip())]
    for i, b in enumerate(rows):
        if compat:
            b |= {"force_chunk": False, "locator": None}
        following = rows[i + 1] if i + 1 < len(rows) else None
        if b["force_chunk"]:
            state.close(0)
            state.heading = b["section_heading"] or state.heading
            state.add(b)
            state.close(0)
        elif looks_like_heading(b["text"]):
            if state.blocks and tokens(state.text()) >= LEAST:
                state.close()
            state.heading = b["text"]
        else:
            if b["boundary"] and state.blocks:
                state.close()
            state.add(b)
            size = tokens(state.text())
            turns = following is not None and (looks_like_heading(following["text"]) or following["boundary"] or following["page"] != b["page"])
            if size >= MOST or (size >= TARGET and turns):
                state.close()
    state.close(0, final=True)
    return state.out


def render_context(notes: list[dict], max_chars: int) -> str:
    """One question's notes under their sub-questions. A note that doesn't fit ends its group, a heading ends all."""
    groups: dict[str, list] = {}
    for n in notes:
        groups.setdefault((n["sub_query"] or "").strip() or "Main question", []).append(n)
    lines, left = [TITLE], max_chars - len(TITLE)
    for name, members in groups.items():
        heading = f"\n## {name}"
        if len(heading) > left:
            break
        lines.append(heading)
        left -= len(heading)
        for n in members:
            text = (n["text"] or "").strip()
            if not text:
                continue
            visuals = f", {len(n['visual_ids'])} figure/table" if n["visual_ids"] is not None and len(n["visual_ids"]) else ""
            line = f"- {text}\n  (source: {(n['doc_title'] or '').strip() or 'Untitled PDF'}, p.{n['page_start']}-{n['page_end']}{visuals})"
            if len(line) + 1 > left:
                break
            lines.append(line)
            left -= len(line) + 1
    return "\n".join(lines)


def table_of(spans: list[dict], y_tol: float, x_gap: float) -> tuple[int, str]:
    centre = lambda s: (s["y0"] + s["y1"]) / 2
    rows, total = [], 0.0
    for s in sorted(spans, key=lambda s: (centre(s), s["x0"], s["text"])):
        if rows and abs(centre(s) - total / len(rows[-1])) <= y_tol:
            rows[-1].append(s)
            total += centre(s)
        else:
            rows.append([s])
            total = centre(s)
    out = io.StringIO()
    writer = csv.writer(out)
    for row in rows:
        row.sort(key=lambda s: s["x0"])
        cells, last = [row[0]["text"]], row[0]["x1"]
        for s in row[1:]:
            if s["x0"] - last >= x_gap:
                cells.append(s["text"])
            else:
                cells[-1] = f"{cells[-1]} {s['text']}".strip()
            last = s["x1"]
        writer.writerow(cells)
    return len(rows), out.getvalue()
