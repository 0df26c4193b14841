"""Signals of one HTML page: the helper that runs inside the page job's tasks.

It reads tags and texts with three patterns and keeps, per element, the range of
texts, headings and actions that lie inside it; the plan cuts those ranges out
of the page's lists, so nested containers cost nothing extra.  Void elements
close at once, an end tag closes everything up to its match (an unmatched one is
ignored), script and style bodies are not text.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
ONCLICK = re.compile(
    r"(?:(?:window|document)?\.?location(?:\.href)?|window\.open|open)\s*(?:=\s*|\(\s*)['\"]([^'\"]+)['\"]", re.I
)
RAW_END = {name: re.compile(f"</{name}", re.I) for name in ("script", "style")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset(("article", "div", "li", "section", "tr"))


class Element:
    """An open element: where its texts, headings and actions begin."""

    __slots__ = ("tag", "signature", "attributes", "flags", "first_text", "first_heading", "first_action", "order",
                 "targets")


def scan(html: str, navigable: list[str], short_text: int) -> dict:
    """All signals of a page as plain lists."""
    texts: list[str] = []
    lengths = [0]
    headings: list[str] = []
    page = {"title": "", "h1_texts": [], "json_ld_blocks": [], "anchors": [], "actions": [], "containers": [],
            "images": [], "headings": headings}
    stack: list[Element] = []
    depth = {"header": 0, "footer": 0, "nav": 0, "main": 0}
    orders = {"a": 0, "action": 0}
    title_parts: list[str] = []

    def say(text: str) -> None:
        clean = " ".join(text.split())
        if clean:
            texts.append(clean)
            lengths.append(lengths[-1] + len(clean))

    def inner_length(element: Element) -> int:
        count = len(texts) - element.first_text
        return lengths[-1] - lengths[element.first_text] + max(count - 1, 0)

    def close(element: Element) -> None:
        tag, attributes = element.tag, element.attributes
        inner = None
        if tag == "a" or element.targets or tag in HEADINGS or tag == "title":
            inner = " ".join(texts[element.first_text:])
        if tag == "a" and attributes.get("href"):
            page["anchors"].append(
                {"ord": element.order[0], "text": inner, "href": attributes["href"], "signature": element.signature,
                 **element.flags, "title_attr": attributes.get("title", ""),
                 "aria_label": attributes.get("aria-label", "")}
            )
        for source, raw in element.targets:
            page["actions"].append(
                {"ord": element.order[1], "text": inner, "raw_url": raw, "tag": tag, "source_attr": source,
                 "signature": element.signature, **element.flags, "title_attr": attributes.get("title", ""),
                 "aria_label": attributes.get("aria-label", "")}
            )
        if tag == "title":
            title_parts.append(inner)
        if tag in HEADINGS and inner:
            headings.append(inner)
            if tag == "h1":
                page["h1_texts"].append(inner)
        if tag in CONTAINERS and len(page["actions"]) > element.first_action:
            length = inner_length(element)
            if length or len(headings) > element.first_heading:
                page["containers"].append(
                    {"ord": len(page["containers"]), "tag": tag, "signature": element.signature, **element.flags,
                     "text_length": length,
                     "text": " ".join(texts[element.first_text:]) if length <= short_text else None,
                     "first_heading": element.first_heading,
                     "heading_count": len(headings) - element.first_heading,
                     "first_action": element.first_action,
                     "action_count": len(page["actions"]) - element.first_action}
                )
        region = "main" if tag == "article" else tag
        if region in depth and depth[region]:
            depth[region] -= 1

    def open_element(tag: str, source: str) -> Element:
        element = Element()
        element.tag = tag
        element.attributes = attributes = {}
        for match in ATTRIBUTE.finditer(source):
            name = match.group(1).lower()
            if name not in attributes:
                value = match.group(2) or match.group(3) or match.group(4) or ""
                attributes[name] = unescape(value) if "&" in value else value
        region = "main" if tag == "article" else tag
        if region in depth:
            depth[region] += 1
        element.flags = {f"in_{name}": count > 0 for name, count in depth.items()}
        mark = tag + (f"#{attributes['id'].lower()}" if attributes.get("id") else "")
        mark += "".join(f".{name.lower()}" for name in attributes.get("class", "").split()[:2])
        outer = stack[-1].signature if stack else []
        element.signature = outer if tag in ("html", "body") else (outer + [mark])[-4:]
        element.first_text, element.first_heading = len(texts), len(headings)
        element.first_action = len(page["actions"])
        element.order = (orders["a"], orders["action"])
        element.targets = []
        if tag == "a":
            orders["a"] += 1
            if attributes.get("href"):
                element.targets.append(("href", attributes["href"]))
        element.targets += [(name, attributes[name]) for name in navigable if attributes.get(name)]
        if attributes.get("onclick"):
            element.targets += [("onclick", raw) for raw in dict.fromkeys(ONCLICK.findall(attributes["onclick"]))]
        if element.targets:
            orders["action"] += 1
        if tag == "img":
            caption = " ".join(attributes.get("alt", "").split())
            if attributes.get("src"):
                page["images"].append(
                    {"ord": len(page["images"]), "src": attributes["src"], "alt_text": caption,
                     "signature": element.signature, **element.flags, "width": attributes.get("width", ""),
                     "height": attributes.get("height", "")}
                )
            say(caption)
        return element

    position = 0
    while True:
        match = TOKEN.search(html, position)
        if match is None:
            say(unescape(html[position:]))
            break
        if match.start() > position:
            say(unescape(html[position:match.start()]))
        position = match.end()
        closing, tag, source = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None:
                while len(stack) > at:
                    close(stack.pop())
            continue
        element = open_element(tag, source)
        if tag in VOID or source.endswith("/"):
            close(element)
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(html, position)
            body = html[position:end.start() if end else len(html)]
            if tag == "script" and element.attributes.get("type", "").lower() == "application/ld+json" and body.strip():
                page["json_ld_blocks"].append(body.strip())
            position = end.start() if end else len(html)
        stack.append(element)
    while stack:
        close(stack.pop())
    page["title"] = " ".join(" ".join(title_parts).split())
    return page
