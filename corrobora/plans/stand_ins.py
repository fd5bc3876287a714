"""Offline stand-ins for the external model, used by named queries and tests only."""

import json
import re

from ..operators.intake import CallFailed

_BLOCK = re.compile(r'<evidence id="(E\d+)" document="doc_(\d+)\.pdf"[^>]*>\n(.*?)\n</evidence>', re.S)


def passage_reader():
    """Quotes the first 40 characters of every passage. What it says of them, and whether it answers at all, depends on the length of the question."""
    def call(model: str, history: list) -> str:
        question, _, shown = history[1][1].removeprefix("QUESTION:\n").partition("\n\nEVIDENCE:\n")
        n = len(question)
        if n % 11 == 5:
            raise CallFailed("HTTP 401", False)
        if n % 13 == 7:
            return "nothing to report"
        claims = [{"id": f"x{i}", "aspect": "t", "evidence": eid, "quote": text[:40], "value": "beta" if n % 4 == 1 and int(doc) % 2 else "alpha", "value_type": "text", "explicit": n % 8 != 4}
                  for i, (eid, doc, text) in enumerate(_BLOCK.findall(shown))]
        aspects = [{"id": "t", "label": "Opening"}] + ([{"id": "u", "label": "Other"}] if n % 4 == 3 else [])
        return json.dumps({"aspects": aspects, "claims": claims, "supersession": [], "answer": [{"text": "As stated.", "claims": ["x0"]}], "ambiguous": n % 4 == 2})
    return call
