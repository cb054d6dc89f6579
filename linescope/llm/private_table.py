"""The small labelled table of personal data: forms of four kinds and look-alikes in made-up sentences.

No table of a corpus marks personal data, so the labels come from a rule: every form below is filled with drawn digits
and names and set into drawn words. ``{}`` marks of a form are replaced; the filled form is the labelled span.
"""

from __future__ import annotations

import random

# --- fixed values: forms and surroundings ------------------------------------------------
FORMS = {
    "email": [
        "u@h.t", "u.n@h.t", "u.n@h.g.t", "u_n@h.t", "u @ h.t", "u at h dot t", "u (at) h (dot) t", "u [at] h [dot] t", "u(at)h.t",
        "u[at]h.t", "u {at} h {dot} t", "u AT h DOT t", "u dot u at h dot t", "u at h dot g dot t", "u-at-h-dot-t",
    ],
    "ip": ["o.o.o.o", "o.o.o.o", "o[.]o[.]o[.]o", "o(.)o(.)o(.)o", "o . o . o . o", "o,o,o,o", "o dot o dot o dot o"],
    "card": ["dddddddddddddddd", "dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddd.dddd.dddd.dddd", "dddd/dddd/dddd/dddd",
             "dddd_dddd_dddd_dddd", "dddd  dddd  dddd  dddd", "dddd dddddd ddddd"],
    "phone": [
        "+1 (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "1-ddd-ddd-dddd", "(ddd)ddd-dddd",
        "+dd dd dddd dddd", "+dd-ddd-ddddddd", "00dd dd dddd dddd", "0dd dddd dddd", "0ddd / dddddd", "ddd/ddd-dddd", "+ dd ddd dddddd",
    ],
    "": [
        "dddd-dd-dd", "dd/dd/dddd", "dd.dd.dddd", "dd:dd:dd", "dd:dd", "$d,ddd.dd", "d.dd", "d.d.d", "vd.d.d", "d.ddddd", "No. dddddd",
        "dddd", "ddd", "d-d", "dd-dd", "d. ", "d.d. ", "ISBN ddd-d-dd-dddddd-d", "page dd of ddd", "u[d] + d", "d,ddd,ddd", "d ddd ddd",
        "token = \"xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx\"", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "@u", "u@u", "u at u", "at dd",
        "ffffffffffffffff", "ffff ffff ffff ffff", "ffff-ffff-ffff-ffff", "b.o.o.o", "o.o.b.b", "o.o.o", "dot u at u", "u dot u", "d%", "#dddd",
        "dd dd dd dd", "d d d d d d d", "ddd ddd", "dd.d.dd.d.dd", "dddddddd", "dddddddddddd", "ud", "(d)", "[dd]", "u (dddd)", "dddd-dddd",
    ],
}
CUES = {
    "email": ["mail", "email", "write to", "contact", "e-mail:", "reach me at"],
    "ip": ["ip", "host", "server", "from", "login from", "address"],
    "card": ["card", "paid with", "card number", "account", "visa"],
    "phone": ["tel", "phone", "call", "fax:", "call me at", "mobile"],
    "": ["the", "on", "see", "for", "about", "since"],
}
ENDS = ["com", "org", "net", "de", "io"]
# ------------------------------------------------------------------------------------------


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        doubled = int(x) * (1 + i % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def _name(rng: random.Random, least: int = 2) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(least, 9)))


def _word(rng: random.Random) -> str:
    word = _name(rng, 1) + rng.choice(["", "", "é", "ß"])
    return rng.choice([word, word, word, word.capitalize(), word.upper()]) + rng.choice(["", "", "", "", ",", ".", "!!", "***", "###"])


def _filled(kind: str, form: str, rng: random.Random) -> str:
    made = {
        "u": lambda: rng.choice([str, str, str.capitalize])(_name(rng)),
        "h": lambda: _name(rng, 3) + rng.choice(["", "", str(rng.randrange(10))]),
        "g": lambda: "example",
        "t": lambda: rng.choice(ENDS),
        "n": lambda: str(rng.randrange(100)).zfill(2),
        "o": lambda: str(rng.randrange(256)),
        "b": lambda: str(rng.randrange(256, 1000)),
        "d": lambda: str(rng.randrange(10)),
        "f": lambda: str(rng.randrange(10)),
        "x": lambda: rng.choice("0123456789abcdef"),
    }
    while True:
        out, i = "", 0
        while i < len(form):
            # A letter stands for its filling unless it is part of a word.
            alone = form[i] in made and (form[i] in "dfx" or not (form[i + 1 : i + 2].isalpha() and form[i + 1] not in "d"))
            word = next((w for w in ("token", "page", "ISBN", "No", "dot", "DOT", "at", "AT", "of") if form.startswith(w, i)), None)
            if word:
                out, i = out + word, i + len(word)
            else:
                out, i = out + (made[form[i]]() if alone else form[i]), i + 1
        digits = "".join(c for c in out if c in "0123456789")
        if kind == "card" and not passes_luhn(digits):
            continue
        if "ffff" in form and passes_luhn(digits):
            continue
        return out


def labelled(seed: int = 1, rounds: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(sentence, spans) rows: every form ``rounds`` times, with and without a word that hints at it."""
    rng, out = random.Random(seed), []
    for kind, forms in FORMS.items():
        for form in forms:
            for _ in range(rounds):
                cues = CUES[kind] if rng.random() < 0.5 else CUES[""] if rng.random() < 0.5 else [_word(rng)]
                head = " ".join([*[_word(rng) for _ in range(rng.randrange(5))], rng.choice(cues)]) if rng.random() < 0.9 else ""
                tail = " ".join(_word(rng) for _ in range(rng.randrange(5)))
                body = _filled(kind, form, rng)
                start = len(head) + bool(head)
                text = (head + " " if head else "") + body + rng.choice(["", "", "", ".", ",", "!!", "***"]) + (" " + tail if tail else "")
                out.append((text, [(kind, start, start + len(body))] if kind else []))
    return out
