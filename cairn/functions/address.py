"""Addresses as people write them, by country."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries that write the number first and the state; of these, the ones with the postcode first.
NUMBER_FIRST = ("US", "CA", "AU", "NZ", "GB", "IE", "ZA", "IN", "NG", "KE", "GH", "PK", "PH", "TH", "MY")
POSTCODE_FIRST = ("JP", "KR", "CN", "TW")
FIELDS = ("house_number", "road", "city", "state", "county", "postcode", "country", "country_code")


def format_rules(code: Column) -> Column:
    """struct<number_after, postcode_before_city, include_state>."""
    one, two = code.isin(*NUMBER_FIRST), code.isin(*POSTCODE_FIRST)
    some = F.coalesce(one | two, F.lit(False))
    return F.struct((~some).alias("number_after"), (~F.coalesce(one, F.lit(False))).alias("postcode_before_city"), some.alias("include_state"))


def display_name(a) -> Column:
    """One line from the FIELDS of ``a`` (a function from a field's name to its column); null if there is little to say."""
    rules = format_rules(a("country_code"))
    text = lambda c: F.coalesce(c, F.lit(""))
    street = F.when(a("house_number").isNull(), a("road")).when(rules["number_after"], F.concat_ws(" ", a("road"), a("house_number"))).otherwise(F.concat_ws(" ", a("house_number"), a("road")))
    street = F.when(a("road").isNotNull(), street)

    def with_state(head: Column) -> Column:
        has = rules["include_state"] & a("state").isNotNull()
        return F.when(has & (head != ""), F.concat(head, F.lit(", "), a("state"))).when(has, a("state")).otherwise(head)

    first = with_state(F.concat(text(F.concat(a("postcode"), F.lit(" "))), text(a("city"))))
    last = with_state(text(a("city")))
    last = F.when(a("postcode").isNull(), last).when(last != "", F.concat(last, F.lit(" "), a("postcode"))).otherwise(a("postcode"))
    place = F.when(rules["postcode_before_city"], F.when(first != "", F.trim(first))).otherwise(F.when(last != "", last))
    little = a("road").isNull() & a("city").isNull() & a("country").isNull()
    return F.when(~little, F.concat_ws(", ", street, place, a("country")))


def address_json(a) -> Column:
    """The answer as JSON: absent fields are left out."""
    inner = F.struct(*(a(f).alias(f) for f in FIELDS))
    return F.to_json(F.struct(display_name(a).alias("display_name"), inner.alias("address")))
