"""The tree builder against a plain one that searches its stack, and its time on deep pages."""

import random
import re
import time

from foliant.llm import html_text as h

TAGS = "p div ul li ol table tr td th tbody thead tfoot caption dl dt dd option select button span b svg math html body head br img".split()


def plain_tree(page):
    """Nested (tag, children) of a page that has only tags and plain text, by looking through all open elements at every tag."""
    root = ("#root", [])
    stack = [root]

    def last(tags):
        return max((k for k in range(1, len(stack)) if stack[k][0] in tags), default=0)

    for closing, tag, empty, text in re.findall(r"<(/?)(\w+)(/?)>|([^<]+)", page):
        if text:
            stack[-1][1].append(text)
        elif closing and tag == "br" or closing and tag == "p" and not last({"p"}):
            stack[-1][1].append((tag, []))
        elif closing:
            barred = 0 if tag in {"table", "tr", "tbody", "thead", "tfoot", "body", "html"} else last(h.SCOPES)
            if last({tag}) and last({tag}) >= barred:
                del stack[last({tag}) :]
        else:
            closes, scope = h.IMPLIED.get(tag, (set(), set()))
            if last(scope):
                inner = [k for k in range(last(scope) + 1, len(stack)) if stack[k][0] in closes]
                del stack[min(inner, default=len(stack)) :]
            elif last(closes):
                del stack[last(closes) :]
            if tag in h.CLOSES_P and last({"p"}) > last(h.SCOPES | {"button"}):
                del stack[last({"p"}) :]
            if tag in ("html", "body") and last({tag}):
                continue
            if tag == "body" and stack[-1][0] == "head":
                stack.pop()
            node = (tag, [])
            stack[-1][1].append(node)
            if tag not in h.VOID and not (empty and (tag in h.UNSEEN or tag in h.FOREIGN or last(h.FOREIGN))):
                stack.append(node)
    return root


def test_tree_against_plain_search():
    def shape(n):
        return n if isinstance(n, str) else (n.tag, [shape(c) for c in n.children])

    rng = random.Random(11)
    for _ in range(4000):
        some = TAGS[: rng.choice((5, 14, len(TAGS)))]
        page = "".join(rng.choice(["<%s>", "</%s>", "<%s/>", "<%s>x", "</%s>y"]) % rng.choice(some) for _ in range(rng.randrange(1, 30)))
        assert shape(h.parse(page)) == plain_tree(page), page


def test_deep_pages_take_linear_time():
    for page in ("<div>" * 100_000, "<ul><li>" * 50_000, "<table><tr><td>" * 33_000, "<p><span>" * 50_000, "<dl><dd>" * 50_000, "<b>" * 50_000 + "</p></i>" * 25_000):
        start = time.process_time()
        h.parse(page + "x")
        assert time.process_time() - start < 5, page[:20]
