"""Made-up personal data, written as expressions over keyed random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facsimile.functions.hashed import uniform

FIRST_NAMES = """Ada Alma Anton Bruno Carla Celia Clara Dario Edith Elena Emil Erik Esther Felix Flora
Greta Hanna Hugo Ida Igor Irene Jonas Julia Karin Leon Lidia Lukas Mara Marco Milan Mina Nadia Nils Nora
Olga Oskar Paula Petra Rafael Rita Robin Rosa Samuel Selma Simon Sofia Tara Theo Ursula Viktor""".split()
LAST_NAMES = """Abbot Archer Barlow Becker Brandt Carver Castro Cole Dalton Draper Ekström Farrow Fischer
Garner Grant Hale Harmon Hofer Ingram Jansen Keller Kovac Lambert Larsen Lowell Marsh Mercer Moreno Nolan
Novak Olsen Osborn Parrish Porter Quinn Ramsey Rossi Sattler Sawyer Thorne Tucker Ulrich Vance Vogel Wagner
Walsh Weber Winter Yates Ziegler""".split()
CITIES = """Alderbrook Amberton Ashford Birchwell Brookhaven Cedarport Clearwater Copperfield Dunmore
Eastvale Elmhurst Fairmont Foxridge Glenwood Hartfield Hollowell Ironbridge Juniper Kingsmere Lakemont
Maplewood Northgate Oakhaven Pinecrest Riverton Silverlake Stonebridge Thornbury Westbrook Willowdale""".split()
STREETS = "Ash Birch Cedar Chestnut Elm Fern Hazel Hill Lake Linden Maple Mill Oak Park Pine River Rose Spring Willow Wood".split()
STREET_KINDS = "Street Avenue Road Lane Drive Court".split()
COUNTRIES = """Argentina Austria Belgium Bolivia Bulgaria Chile Croatia Denmark Ecuador Estonia Finland Ghana
Greece Hungary Iceland Ireland Jamaica Kenya Latvia Malta Nepal Norway Panama Poland Portugal Senegal Slovenia
Sweden Uruguay Zambia""".split()
COMPANY_KINDS = "Group Holdings Partners Systems Trading Works".split()
WORDS = """amber basin candle delta ember fabric garden harbor island jacket kernel ladder marble needle
orchard pepper quarry ribbon saddle timber umbrella valley window yellow zenith""".split()


def fake(kind: Column | str, column: str, seed: int, *keys: Column) -> Column:
    """A made-up value of one semantic kind; the same keys and seed give the same value."""
    draw = lambda tag: uniform(f"fake/{column}/{tag}", seed, *keys)

    def pick(words: list[str], tag: str) -> Column:
        index = F.floor(draw(tag) * len(words)).cast("int") + 1
        return F.element_at(F.array(*[F.lit(w) for w in words]), index)

    number = lambda tag, low, high: F.floor(draw(tag) * (high - low) + low).cast("int")
    first, last = pick(FIRST_NAMES, "first"), pick(LAST_NAMES, "last")
    zipcode = F.format_string("%05d", number("zip", 501, 99951))
    address = F.format_string(
        "%d %s %s, %s, %s", number("house", 1, 10000), pick(STREETS, "street"),
        pick(STREET_KINDS, "way"), pick(CITIES, "town"), zipcode)
    kinds = {
        "email": F.format_string("%s.%s%d@example.com", F.lower(first), F.lower(F.translate(last, "ö", "o")), number("n", 1, 100000)),
        "first_name": first,
        "last_name": last,
        "name": F.concat_ws(" ", first, last),
        "phone_number": F.format_string("(%03d) 555-%04d", number("area", 200, 1000), number("line", 0, 10000)),
        "address": address,
        "city": pick(CITIES, "town"),
        "zipcode": zipcode,
        "country": pick(COUNTRIES, "country"),
        "company": F.concat_ws(" ", last, pick(COMPANY_KINDS, "company")),
    }
    return kinds.get(kind, pick(WORDS, "word"))
