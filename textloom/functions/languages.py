"""What single languages need beyond the universal sentence splitter: abbreviations behind which a sentence goes on, and terminators that need no white space behind them."""

from __future__ import annotations

import re

#: Without their last dot. What often ends a sentence itself ("etc.") isn't among them.
ABBREVIATIONS = {
    "en": "al approx apt assn ave blvd cf co corp dept e.g est fig figs gen gov i.e inc jr lt ltd mt no nos pp rev sgt sr viz vol vols vs",
    "de": "abs allg bspw bzw ca d.h dgl ebd evtl geb gem ggf inkl jh lfd max mind mio mrd nr o.ä s.o s.u sog st str tel u.a u.u v.a vgl z.b z.t zzgl",
    "fr": "av bd cf chap c.-à-d coll env ex fig hab m mm mme mlle n.b p.ex pp réf s.v tél vol",
    "es": "aprox art av cap cf d dña dpto ej fig gral izq núm p.ej pág págs prof sr sra sres sta tel ud uds vol",
    "it": "art avv cap cfr d.c a.c dott es fig ing p.es pag pagg prof sig sigg sig.ra tel vol",
    "pt": "art av cap cf dr dra ex fig nº p.ex pág págs prof sr sra sras tel vol",
    "nl": "bijv blz bv c.q ca d.w.z dhr dr e.d evt fig i.p.v incl jl mevr m.a.w nr o.a prof resp t.a.v t.w vgl",
    "sv": "bl.a ca d.v.s dr ev f.d fig fr.o.m inkl kap nr p.g.a resp s.k t.ex t.o.m tel",
    "da": "bl.a ca d.v.s dr evt f.eks fig fx hhv inkl kap nr pga s.k tlf vedr",
    "pl": "al art dr gen godz hab im inż jw kap lek m.in mgr nr np nt pkt płk prof red rys str św tab tel tj tzn tzw ul ur wyd zob",
    "cs": "apod ing kap kupř mj mudr např nábř obr odd phdr popř prof resp str sv tab tj tzv ul viz",
    "ru": "акад гл доц др и.о им инж кв корп млн млрд наб напр обл пер пл пос просп проф руб рис см стр т.е т.к т.н тел тыс ул",
    "uk": "акад вул гл див доц ім інж млн млрд напр обл просп проф рис см ст т.зв тел тис",
    "tr": "av bkz cad doç dr hz örn prof sok yrd",
}
#: Terminators behind which a sentence ends though a letter follows at once, by language.
CLOSED_UP = {"ja": "。！？｡", "zh": "。！？｡", "hi": "।॥", "mr": "।॥", "ne": "।॥", "sa": "।॥", "bn": "।॥", "as": "।॥", "or": "।॥", "pa": "।॥", "my": "။"}


def abbreviation_pattern(code: str, space: str) -> str | None:
    """Pattern of a language's abbreviations with their dots, in either case; dots inside them may have a space behind."""
    if code not in ABBREVIATIONS:
        return None
    forms = (re.escape(a).replace(r"\.", rf"\.[{space}]?").replace(r"\-", "-") for a in sorted(ABBREVIATIONS[code].split(), key=len, reverse=True))
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(forms)})\."


def closed_up_pattern(code: str, space: str) -> str | None:
    """Pattern of terminators (group 1) right before the next sentence."""
    return rf"([{CLOSED_UP[code]}]+)(?=[^{space}{CLOSED_UP[code]}])" if code in CLOSED_UP else None
