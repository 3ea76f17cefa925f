"""Label cases generated from a small vocabulary: family x direction x line x half x side x sport.

(market label, selection label, market, selection, line, scope, sport); the market is NULL where no sure mapping exists.
"""

from __future__ import annotations

HOME, AWAY = "Norvel", "Quimbaz"

WORDS = {
    "goals": ("Buts inscrits", "Goals scored"), "shots": ("Tirs tentes", "Shots taken"),
    "shots_on_target": ("Tirs cadres", "Shots on target"), "corners": ("Corners obtenus", "Corner count"),
    "tackles": ("Tacles", "Tackles won"), "fouls": ("Fautes commises", "Fouls given"),
    "cards": ("Cartons montres", "Cards shown"), "saves": ("Saves made", "Arrets du gardien"),
    "var": ("VAR", "Appels VAR"), "offside": ("Hors-jeu", "Offsides called"), "points": ("Points marques", "Points"),
    "rebounds": ("Rebonds pris", "Rebounds"), "assists": ("Passes decisives", "Assists"),
}
DIRECTIONS = {"over": ("plus de {}", "Over {}", "> {}", "anwo {}"), "under": ("moins de {}", "Under {}", "< {}", "anba {}")}
HALVES = {"": "", "_1h": " 1ere mi-temps", "_2h": " 2nd half"}
SIDES = {None: "", "home": f" de {HOME}", "away": f" - {AWAY}"}
RESULTS = {"home": ("1", "Domicile"), "draw": ("X", "Nul"), "away": ("2", "Away")}


def _totals() -> list[tuple]:
    out = []
    for f, (family, words) in enumerate(WORDS.items()):
        for d, (pick, forms) in enumerate(DIRECTIONS.items()):
            for h, (suffix, half) in enumerate(HALVES.items()):
                for s, (scope, side) in enumerate(SIDES.items()):
                    turn, line = f + d + h + s, 3 * f + 2 * h + s + 0.5
                    market = family + ("_team" if scope else "_total") + suffix
                    out.append((words[turn % 2] + side + half, forms[turn % 4].format(line), market, pick, line, scope, "football"))
        for n, form in enumerate(("{} ou plus", "{}+", "{} or more")):
            out.append((words[n % 2], form.format(f + n + 2), f"{family}_total", "over", f + n + 1.5, None, "football"))
    return out


def _results() -> list[tuple]:
    out = []
    for suffix, half in HALVES.items():
        for pick, texts in RESULTS.items():
            for text in texts:
                out.append(("Resultat final" + half, text, "1x2" + suffix, pick, None, None, "football"))
                regular = ("Resultat, regular time" + half, text, "bb_result_reg" + suffix, pick, None, None, "basketball")
                out.append(regular)
                if pick != "draw":
                    out.append(("Vainqueur" + half, text, "bb_moneyline" + suffix, pick, None, None, "basketball"))
    for label in ("BTTS", "Both teams to score"):
        for pick, texts in {"over": ("Oui", "Yes"), "under": ("Non", "No")}.items():
            out += [(label, text, "btts", pick, None, None, "football") for text in texts]
    return out


ACCEPTED = _totals() + _results()

# No mapping, or one under the confidence bound: unknown words, a family without a number, handicaps, promotions.
OPEN = (
    [(f"Pari {word}", "Choix") for word in ("mascotte", "meteo", "maillot", "ballon", "hymne", "pelouse")]
    + [(words[0], "Oui") for words in WORDS.values()]
    + [(f"Handicap {n}", f"1 ({n}:0)") for n in range(1, 5)]
    + [(f"Resultat final {promo}", text) for promo in ("2UP", "cashback", "assurance") for text in ("1", "2")]
)

CASES = ACCEPTED + [(m, s, None, None, None, None, "football") for m, s in OPEN]


def sql_values(rows: list[tuple]) -> str:
    def text(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
