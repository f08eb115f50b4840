"""Labelled texts to train the span classifiers on: made up, seeded, of a bounded number.

Lines of commit histories, with personal information of many formats in many contexts, among
lines that resemble it and hold none. Names, numbers and places are invented by rule.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

Span = tuple[str, int, int]


class Maker:
    def __init__(self, given: list[str], seed: int):
        self.r = random.Random(seed)
        self.given = given
        self.other = "Olga Bruno Clara Dieter Emma Farid Grace Hannah Ivan Jordan Karim Laura Maxime Nora Oscar Paul Rosa Sven Theo Uma Vera Walter Yara Zane Austin Chelsea Florence Victoria".split()

    def pick(self, *options):
        return self.r.choice(options)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def stem(self, n: int | None = None) -> str:
        return "".join(self.r.choice("bdfghjklmnprstvwz") + self.r.choice("aeiou") for _ in range(n or self.r.randint(1, 3)))

    def word(self) -> str:
        return self.pick("parser", "bucket", "tile", "street", "cache", "ledger", "vector", "route", "page", "token", "filter", "header", "number", "index", "worker", "queue")

    def first(self) -> str:
        return self.r.choice(self.given) if self.given and self.r.random() < 0.7 else self.r.choice(self.other)

    def family(self) -> str:
        one = lambda: (self.stem() + self.pick("berg", "son", "ley", "mann", "quist", "ard", "ova", "el", "ini", "feld", "man", "er", "é", "wick", "ko")).capitalize()
        x = self.r.random()
        return one() + "-" + one() if x < 0.08 else "O" + self.pick("'", "’") + one() if x < 0.16 else self.pick("von ", "van der ", "de ", "van ") + one() if x < 0.24 else one()

    def name(self) -> str:
        a, b = self.first(), self.family()
        x = self.r.random()
        if x < 0.08:
            return f"{a[0]}. {b}"
        if x < 0.16:
            return f"{a} {self.r.choice('ABCDEFGHJKLMNPRSTW')}. {b}"
        return f"{b}, {a}" if x < 0.2 and " " not in b else f"{a} {b}"

    def host(self) -> list[str]:
        return self.pick(["example", "com"], ["example", "org"], ["mail", "example", "net"], ["uni", "example"], [self.stem(2), "test"], [self.stem(2) + "-" + self.stem(1), "invalid"], ["users", "forge", "example"])

    def email(self, name: str | None = None) -> str:
        parts = [p.lower() for p in (name or self.name()).replace(",", "").replace(".", "").split()]
        local = self.pick(".", "_", "").join([parts[0], parts[-1]]) if self.r.random() < 0.7 else parts[0][0] + parts[-1]
        local = "".join(c for c in local if c.isascii() and c not in "'’") or "someone"
        local += self.pick("", "", "", "+lists", "+git", self.digits(2)) if self.r.random() < 0.8 else ""
        host = self.host()
        x = self.r.random()
        if x < 0.75:
            return local + "@" + ".".join(host)
        at, dot = self.pick(("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), (" (at) ", "."), ("(at)", "."))
        return local + at + dot.join(host)

    def phone(self) -> str:
        d = self.digits
        a = self.pick("212", "303", "415", "617", "808", "919")
        return self.pick(
            f"{a}-555-{d(4)}", f"{a}.555.{d(4)}", f"({a}) 555 {d(4)}", f"({a}) 555-{d(4)}", f"+1 ({a}) 555-{d(4)}", f"+1{a}555{d(4)}", f"+1 {a} 555 {d(4)}",
            f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{self.pick(1, 6)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{self.pick(1, 6)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"030/{d(5)}-{d(3)}", f"030 {d(5)} {d(3)}", f"+49 30 {d(8)}", f"+49 89 {d(4)} {d(4)}", f"01632 960 {d(3)}", f"01632 960{d(3)}", f"+44 1632 960{d(3)}", f"+44 (0)1632 960{d(3)}",
            f"+44 20 7946 0{d(3)}", f"020 7946 0{d(3)}", f"07700 900{d(3)}", f"+34 91{self.pick('', ' ')}{d(3)} {d(2)} {d(2)}",
        )

    def id_number(self) -> tuple[str, str]:
        """Label and number; the label is '' where the number's form alone tells."""
        d = self.digits
        kind = self.r.randint(0, 3)
        if kind == 0:
            n = self.pick(f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}", f"{d(3)}-{d(2)}-{d(4)}")
            label = self.pick("ssn ", "SSN ", "SSN: ", "ssn=", "ssn: ", "social security no. ", "social security number ")
            return ("" if "-" in n and self.r.random() < 0.3 else label), n
        if kind == 1:
            n = self.pick(f"QQ{d(6)}{self.pick(*'ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {self.pick(*'ABCD')}", f"{self.r.choice('ABEHJKM')}{self.r.choice('ABEHJKM')}{d(6)}{self.pick(*'ABCD')}")
            return self.pick("", "NI number ", "national insurance no. ", "NINO: "), n
        if kind == 2:
            return self.pick("passport ", "passport no. ", "Passport: ", "Passport number "), self.pick("XZ", "XQ", "XX", "X", "C", "PA") + d(7)
        return self.pick("ID card no. ", "tax id ", "national id ", "tax number ", "identity card "), f"{d(2)}-{d(5)}-{d(1)}"

    def address(self) -> tuple[str, str, str]:
        """What comes before, the house and street, what comes after."""
        n = str(self.r.randint(1, 290)) + (self.pick("A", "B", "C") if self.r.random() < 0.1 else "")
        b = (self.stem(3) + self.pick("gate", "holt", "mere", "by", "low", "dale", "ton")).capitalize()
        town = self.stem(2).capitalize() + self.pick("ville", "bay", "cross", "stad")
        x = self.r.randint(0, 3)
        if x == 0:
            way = self.pick("Street", "Road", "Lane", "Avenue", "Drive", "Terrace", "Place", "Court", "Crescent", "Boulevard", "St", "Rd", "Ln", "La", "Ave", "Dr", "Drv", "Ter", "Tce", "Pl", "Ct", "Cres", "Blvd", "Bvd")
            street = f"{n} {self.pick('', '', '', 'North ', 'Old ', 'Upper ', 'Mount ')}{b} {way}"
        elif x == 1:
            street = b + self.pick("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "-Allee", "-Platz", "wg.", "pl.") + " " + n
        elif x == 2:
            street = f"{n} {self.pick('rue de', 'avenue de', 'chemin de', 'place', 'impasse', 'bd', 'boulevard', 'rue', 'av.', 'rue du')} {b}"
        else:
            street = self.pick("Calle", "Plaza", "Paseo", "Camino", "Avenida", "Avda.", "C/", "Pza.", "Pso.", "Cno.") + f" {b} {n}"
        before = self.pick("", "", "", "Flat 3, ", "Unit 12, ", "Apt 7, ") if x == 0 else ""
        after = self.pick("", f", {town}", f", {self.digits(5)} {town}")
        return before, street, after

    def line(self) -> list[str | tuple[str, str]]:
        """Pieces of one line; a pair is a kind and its surface."""
        name = self.name()
        full = name if "," not in name else self.name().replace(",", "")
        n, e, p = ("name", full), ("email", self.email(full)), ("phone", self.phone())
        w, d = self.word(), self.digits
        label, number = self.id_number()
        before, street, after = self.address()
        a = [before, ("address", street), after]
        x = self.r.randint(0, 62)
        plus = self.pick("+", "-", " ", "    ", "+    ", "")
        if x < 5:
            return [self.pick("Author: ", "From: ", "user:        ", "Author:     ", "Commit: "), *([n] if self.r.random() < 0.2 else [n, " <", e, ">"])]
        if x < 8:
            return [plus if plus.strip() == "" else "    ", self.pick("Signed-off-by: ", "Reviewed-by: ", "Co-authored-by: ", "Tested-by: ", "Reported-by: ", "Acked-by: "), n, " <", e, ">"]
        if x < 9:
            return [f"r{d(6)} | ", n, " <", e, f"> | 2024-03-0{d(1)} 12:{d(2)}:10 +0200 | {d(1)} lines"]
        if x < 14:
            left, right = self.pick(
                ("Thanks to ", " for the report."), ("Danke an ", " für den Hinweis."), ("Merci à ", " pour le test."), ("Reviewed with ", " in person."), ("Reported by ", " on the call."),
                ("Ticket raised by ", "; see the log."), ("", " asked for this twice."), ("As ", " pointed out, it was stale."), ("Spoke to ", " about it."), ("Gracias a ", " por el aviso."), ("Suggested by ", "."), ("Pairing with ", " today."),
            )
            return [plus.replace("+", " ").replace("-", " "), left, ("name", name), right]
        if x < 16:
            return [plus, self.pick(f"// TODO(", "# FIXME("), n, "): drop this"] if self.r.random() < 0.5 else [plus, self.pick("/* Copyright 2023 ", "# Copyright (c) 2021 ", "# written by ", "// author: "), n, self.pick("", " */")]
        if x < 19:
            return [plus, self.pick('"author": "', '{"name": "', 'maintainer = "', "reviewer: ", "  - ", "owner: ", "'"), n, *self.pick(['",'], ['", "email": "', e, '"},'], [" <", e, '>"'], [""], [", ", e])]
        if x < 22:
            return self.pick([plus, '{"contact": "', n, '", "phone": "', p, '"},'], [plus, d(4), ",", n, ",", p], [plus, "INSERT INTO contacts VALUES (", d(4), ", '", n, "', '", p, "');"], [plus, "contact: ", n, "\t# ", p])
        if x < 25:
            left, right = self.pick(("On-call phone: ", ""), ("Call ", " before the deploy."), ("tel ", ""), ("reachable on ", " until Friday"), ("Support asked to ring ", "."), ("Rückruf unter ", ""), ("fax: ", ""), ("mobile ", ", evenings"), ("Tel.: ", ""))
            return ["    ", left, p, right]
        if x < 29:
            return self.pick(["    Contact ", n, ", ", p, ", ", e, "; office at ", *a, "."], ["    ", n, " / ", *a, " / ", p, " / ", e], ["    ", n, " (", e, ", ", p, ") wants it shipped to ", *a, "."])
        if x < 32:
            left, right = self.pick(("Dump contained ", ", now dropped."), ("Test row: ", ""), ("The sample still had ", "."), ("Customer gave ", " in the ticket."), ("comment: ", ""), ('user.note = "', '"'), ("# ", ""), ("log.debug('row %s', '", "')"))
            return [plus, left, label, ("id_number", number), right]
        if x < 36:
            left, right = self.pick(("- query: ", ""), ("// e.g. ", ""), ('geocode("', '")'), ("Repro: search for ", "."), ("The user lives at ", "."), ("Lookup of ", " failed."), ("Parcel sent to ", " came back."), ('{"q": "', '", "limit": 3},'), ("deliver to ", ""))
            return [plus, left, *a, right]
        if x < 38:
            left, right = self.pick(("Questions go to ", "."), ("cc ", ""), ("write to ", " instead"), ("(", ")"), ("The report from ", " has the trace."), ("Contact: ", ""), ("mailto:", " bounced"), ("export GIT_EMAIL=", ""))
            return [plus.replace("+", " "), left, ("email", self.email()), right]
        if x < 39:
            return [self.pick("Author: ", "From: ", "    Signed-off-by: "), self.pick("sync-robot", "deps-robot", self.stem(3) + d(2)), " <", ("email", self.email() if self.r.random() < 0.5 else d(6) + "+" + self.stem(3) + "@users.forge.example"), ">"]
        v = f"{d(1)}.{d(4)}.{d(3)}"
        cap, city = self.word().capitalize(), self.r.choice(self.other)
        day = self.pick("Mon Jan", "Tue Feb", "Wed Mar", "Fri Apr", "Sat May", "Sun Dec", "Thu Nov")
        return [plus + self.pick(
            f'"{w}@{v}": "{v}",', f"git clone git@forge.example:{w}/{w}.git", f"DB_URL=postgres://svc:pw{d(4)}@db.internal.example:5432/{w}", f"import {{ {cap} }} from '@{w}/{w}';", f"@{w}.register", f"ssh://git@forge.example/{w}.git", f"icon-{w}@2x.png", f"npm i {w}@{v}",
            f"index {d(3)}e{d(3)}..{d(7)} 100644", f"index a{d(6)}..{d(7)} 100644", f"id: 550e8400-{d(4)}-41d4-a716-{d(12)}", f'"coordinates": [{d(3)}.{d(5)}, {d(2)}.{d(5)}],', f"point: [{d(2)}.{d(5)}, -{d(3)}.{d(5)}]", f"image: registry.example/{w}:{v}", f"version {d(1)}.{d(4)}.{d(3)}", f"# range {d(3)}-{d(3)}-{d(2)} rows", f"# range {d(4)}-{d(3)}-{d(2)} rows", f"range {d(4)}-{d(2)}-{d(2)} rows", f"# lines {d(4)}-{d(4)}", f"pages {d(3)}-{d(2)}-{d(4)} of the log", f"# pushed to git@forge.example:{w}/{w}.git", f"origin git@forge.example:{w}/{w}.git (fetch)",
            f"use crate::{w}::{{{cap}, {self.word().capitalize()}}};", f"use crate::{w}::{{{cap}, {self.word().capitalize()}}};", "Für Aufrufer ändert sich nichts.", "Größere Umbauten folgen später.", f"-----{self.pick('BEGIN', 'END')} {self.pick('RSA', 'INVENTED', 'TEST')} PRIVATE KEY-----", f"import {{ {cap}, {self.word().capitalize()} }} from './{w}';", f"struct {cap}, {self.word().capitalize()}", f"Vec<{cap}> for {cap} {self.word().capitalize()}", f"Aucun Changement pour {cap}", f"Sin Cambios",
            f"epoch 1{d(13)}, offset {d(4)}", f"build: 2024{d(11)}", f"# isbn-like 9780000{d(4)}", f"Released as v{v} on 2024-01-1{d(1)}.", f"Part no. {d(2)}-{d(4)}-{d(3)}X", f"Part no. {d(1)}-{d(2)}-{d(3)}X", f"Works on 192.0.2.{d(1)} and 198.51.100.{d(2)}", f"curl http://192.0.2.4:{d(3)}/{w}",
            f"It used to fail with error code {d(4)}, see build {d(3)}.{d(2)}.", f"index {d(7)}..{d(7)} 100644", f"@@ -{d(3)},{d(1)} +{d(3)},{d(1)} @@", f"Measured on {d(3)} rows: {d(3)} ms before, {d(2)} ms after.", f'"coordinates": [-{d(2)}.{d(5)}, {d(2)}.{d(5)}],', f"Date: 2024-0{d(1)}-1{d(1)} 12:{d(2)}:10 -0500", f"changeset: {d(4)}:{d(12)}", f"sha256 {d(40)}", f"order 2023-{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)} rows", f"size {d(9)} bytes", f"offset {d(3)} {d(2)} {d(4)}", f"ticket {self.r.choice('ABC')}{self.r.choice('XYZ')}-{d(7)}", f"error E{d(7)} raised",
            f"From {d(12)}abcdef {day} 9 08:36:53 2023", f"The {city} release is frozen", f"{cap} Street had no houses in the tile", f"impl {cap} for {self.word().capitalize()} {{", "Ohne Sperre konnte der Cache den Index zweimal lesen.", '"queue": "Gültige Straße – Cache"', f"Add 5 Road variants", f"func (buf *Street) Emit{cap}(ctx context.Context) error {{", f"Merge branch '{w}' of forge.example", f"{cap} {self.word().capitalize()} Guide", f"See The {cap} Manual", f"GROUP BY 1 HAVING count(*) > {d(4)};", f"CREATE INDEX {w}_idx ON {w}s ({w}_id);", f"Revert \"{cap} {w}\"", f"Thanks to {city} for the report.", f"Author: {self.stem(3)}{d(2)}", f"Author: {city}", f"Reported by {city} on the call.", f"Subject: [PATCH 1/3] Refactor {cap} Writer", f"New York Times style", f"United States and North America", f"Add North Road", f"on Main Street at noon", f"Open Street Map import", f"Apache License Version 2.0", f"Visual Studio Code", f"Contact Support", f"Call Center Team", f"Call Stack Depth", f"Thanks Everyone", f"Dear Sir", f"Test Row Count", f"Customer Table Name", f"Error Code {d(4)}",
        )]

    def document(self) -> tuple[str, list[Span]]:
        text, spans = "", []
        for _ in range(self.r.randint(6, 14)):
            for piece in self.line():
                if isinstance(piece, tuple):
                    spans.append((piece[0], len(text), len(text) + len(piece[1])))
                    text += piece[1]
                else:
                    text += piece
            text += self.pick("\n", "\n", "\n", "\r\n", "\n\n")
        return text, spans


def labelled(given: list[str], documents: int, seed: int) -> Iterator[tuple[str, list[Span]]]:
    maker = Maker(given, seed)
    for _ in range(documents):
        yield maker.document()
