"""Annual reports in HTML: the sections that their table of contents names."""

from __future__ import annotations

import re
from collections.abc import Callable

# Items of annual reports, and those that are prose.
ITEMS = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity", "6": "Selected Financial Data", "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements with Accountants", "9A": "Controls and Procedures", "9B": "Other Information",
    "9C": "Disclosure Regarding Foreign Jurisdictions", "10": "Directors and Executive Officers", "11": "Executive Compensation", "12": "Security Ownership", "13": "Certain Relationships", "14": "Principal Accountant Fees", "15": "Exhibits",
}
PROSE = frozenset("1 1A 1B 1C 2 3 7 7A 9 9A".split())
# End of fixed values.
_NUMBER = r"(1[0-5]|9[ABC]|7A|1[ABC]|[1-9])"
#: An entry ends behind its number, or goes on behind a stop: "Item 5 of the plan" is prose.
_ITEM = re.compile(rf"\bitem[\s._\xa0-]*{_NUMBER}(?=\s*(?:[.:\-–—]|$))", re.I)
_SLUG = re.compile(rf"item[_-]*{_NUMBER}(?![0-9A-Za-z])", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*[\"']#([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)


def is_filing(data: bytes) -> bool:
    head = data[:4096].lower()
    return any(x in head for x in (b"xmlns:ix=", b"<ix:header", b"sec.gov"))


def contents(page: str) -> list[tuple[str, str]]:
    """(item, anchor) of the links of the table of contents, by link text, by anchor, or by the row of a table."""
    found: list[tuple[str, str]] = []
    seen: set[str] = set()
    for m in _LINK.finditer(page):
        anchor = m[1]
        if anchor in seen:
            continue
        label = re.sub(r"&(?:nbsp|#160);", " ", re.sub(r"<[^>]+>", " ", m[2]))
        hit = _ITEM.search(label) or _SLUG.search(anchor)
        if not hit:
            row = page.rfind("<tr", max(0, m.start() - 2000), m.start())
            between = page[row : m.start()] if row >= 0 else ""
            hit = _ITEM.search(re.sub(r"<[^>]+>|&(?:nbsp|#160);", " ", between)) if "</tr" not in between else None
        if hit:
            seen.add(anchor)
            found.append((hit[1].upper(), anchor))
    return found


def bold_headings(page: str, longest: int = 120) -> str:
    """Blocks whose only content is bold become second-level headings."""

    def swap(m: re.Match) -> str:
        text = re.sub(r"<[^>]+>", "", m["inner"]).strip().removesuffix(".")
        return f"<h2>{text}</h2>" if text and len(text) <= longest else m[0]

    bold = r"(?:<(?:b|strong)\b[^>]*>(?P<x>.*?)</(?:b|strong)>|<span\b[^>]*font-weight:\s*(?:bold|bolder|[6-9]\d\d)\b[^>]*>.*?</span>)"
    return re.sub(rf"<(?P<tag>p|div|td|th|li)\b[^>]*>\s*(?P<inner>{bold})\s*</(?P=tag)>", swap, page, flags=re.I | re.S)


def stripped(page: str) -> str:
    page = re.sub(r"<(script|style|ix:header|ix:hidden|ix:references|ix:resources)\b.*?</\1\s*>", " ", page, flags=re.I | re.S)
    page = re.sub(r"<(?:p|div|br|tr|li|h[1-6]|table)\b[^>]*>", "\n", page, flags=re.I)
    import html

    text = html.unescape(re.sub(r"<[^>]+>", "", page)).replace("\xa0", " ")
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def filing_text(page: str, to_markdown: Callable[[str], str], *, prose_only: bool = True, infer_headings: bool = False) -> str:
    toc = contents(page)
    if not toc:
        return stripped(page)
    places = []
    for item, anchor in toc:
        if m := re.search(rf"<[^>]*\b(?:id|name)\s*=\s*[\"']{re.escape(anchor)}[\"']", page, re.I):
            places.append((m.start(), item))
    places.sort()
    out = []
    for (start, item), end in zip(places, [*(p for p, _ in places[1:]), len(page)], strict=True):
        if prose_only and item not in PROSE:
            continue
        own = page[start:end]
        body = to_markdown(re.sub(r"<(ix:header|ix:hidden)\b.*?</\1\s*>", "", bold_headings(own) if infer_headings else own, flags=re.I | re.S))
        if body:
            out.append(f"# Item {item}.  {ITEMS.get(item, '')}\n\n{body}")
    return "\n\n---\n\n".join(out) or stripped(page)
