"""Plain-Python statements of the segmentation and redaction rules, for comparison only."""

from __future__ import annotations


def passages(ids, size=8, stride=6, page=512):
    out = []
    for base in range(0, len(ids), page):
        chunk = ids[base : base + page]
        for at in range(0, len(chunk), stride):
            group = chunk[at : at + size]
            out.append((group[0], group[-1], len(group)))
    return out


def turns(rows, gap=120, max_messages=20, max_chars=2000):
    """rows: (id, seconds or None, speaker, text) in id order, of one conversation."""
    out = []
    for mid, at, speaker, text in rows:
        if not text:
            continue
        last = out[-1] if out else None
        if (
            last
            and last["speaker"] == speaker
            and last["n"] < max_messages
            and len(last["text"]) + len(text) + 1 <= max_chars
            and last["end"] is not None
            and at is not None
            and 0 <= at - last["end"] <= gap
        ):
            last.update(last=mid, end=at, n=last["n"] + 1, text=last["text"] + "\n" + text)
        else:
            out.append(dict(first=mid, last=mid, end=at, speaker=speaker, n=1, text=text))
    return out


def windows(turn_list, size=5, stride=4, min_turns=3, min_speakers=2):
    out = []
    for at in range(0, len(turn_list), stride):
        group = turn_list[at : at + size]
        if len(group) >= min_turns and len({t["speaker"] for t in group}) >= min_speakers:
            text = "\n".join(t["text"] for t in group)
            out.append((group[0]["first"], group[-1]["last"], len(group), text))
    return out
