"""Ordered rule cascades, slot values and act categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import clock, fold_apostrophes

#: Number words of counted slots, aliases of areas and prices, slots that hold times.
NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}
AREAS = {"center": "centre", "city centre": "centre", "city center": "centre"}
PRICES = {"inexpensive": "cheap", "moderately priced": "moderate", "moderately": "moderate"}
COUNTED = ("people", "stay", "stars")
TIMES = ("time", "leave", "arrive", "leaveat", "arriveby", "leave_at", "arrive_by")
DOMAINS = ("attraction", "hospital", "hotel", "police", "restaurant", "taxi", "train")
CATEGORIES = ("info_seeking", "booking", "travel", "recommendation", "no_request")
SOCIAL = ("general-thank", "general-bye", "general-greet")


def _looked_up(x: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), x)


def slot_value(key: Column, value: Column) -> Column:
    """A slot's value in one spelling; key is domain.slot."""
    slot, v = F.substring_index(key, ".", -1), fold_apostrophes(value)
    return F.when(slot.isin(*COUNTED), _looked_up(v, NUMBERS)).when(slot == "area", _looked_up(v, AREAS)).when(slot.isin("price", "pricerange"), _looked_up(v, PRICES)).when(slot.isin(*TIMES), F.coalesce(clock(v), v)).otherwise(v)


def first_match(x: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first rule whose pattern is found in x."""
    out = F.when(x.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(x.rlike(pattern), name)
    return out.otherwise(otherwise)


def act_domains(acts: Column) -> Column:
    """Domains that a map of acts names: the part before the dash, in lower case, if it is one."""
    return F.array_sort(F.array_intersect(F.transform(F.map_keys(acts), lambda k: F.lower(F.substring_index(k, "-", 1))), F.array(*map(F.lit, DOMAINS))))


def social_only(acts: Column) -> Column:
    return (F.size(F.map_keys(acts)) > 0) & F.forall(F.map_keys(acts), lambda k: k.isin(*SOCIAL))


def categories(acts: Column) -> Column:
    """All categories of a turn, acts being a map of act to its slots; null without acts.

    A request, or anything of the service domains, seeks information; people or length of stay make a booking; travel domains
    travel; a search domain recommends unless it only gives booking details.
    """
    entries = F.filter(F.map_entries(acts), lambda e: ~e["key"].isin(*SOCIAL))

    def of(e: Column) -> Column:
        domain, kind, slots = F.substring_index(e["key"], "-", 1), F.substring_index(e["key"], "-", -1), e["value"]
        booking = F.arrays_overlap(slots, F.array(F.lit("People"), F.lit("Stay")))
        more = F.size(F.array_except(slots, F.array(*map(F.lit, ("People", "Stay", "Day", "Time", "none"))))) > 0
        inform = kind == "Inform"
        found = F.array(
            F.when((kind == "Request") | domain.isin("Hospital", "Police"), "info_seeking"),
            F.when(inform & booking, "booking"),
            F.when(inform & domain.isin("Train", "Taxi"), "travel"),
            F.when(inform & domain.isin("Hotel", "Restaurant", "Attraction") & (~booking | more), "recommendation"),
        )
        return F.filter(found, lambda c: c.isNotNull())

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(entries, of))))
    return F.when(F.size(F.map_keys(acts)) == 0, None).when(social_only(acts), F.array(F.lit("no_request"))).otherwise(found)


def primary(found: Column) -> Column:
    """The first category in the fixed order."""
    out = F.when(F.array_contains(found, CATEGORIES[0]), CATEGORIES[0])
    for c in CATEGORIES[1:]:
        out = out.when(F.array_contains(found, c), c)
    return out
