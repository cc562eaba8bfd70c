"""Addresses taken apart, as they are written in general."""

from kinmatch.llm import addresses, gazetteer


def parts(text, country="us"):
    a = addresses.parse(text, country)
    return a.number, a.street, a.kind, a.post


def test_names_of_several_words_numbers_and_directions():
    assert parts("12345 Oak Street, Springfield 62704") == ("12345", "oak", "street", "62704")
    assert parts("12A Oak Street") == ("12a", "oak", "street", "")
    assert parts("12 Martin Luther King Blvd") == ("12", "martin luther king", "boulevard", "")
    assert parts("12 Old Park Road") == ("12", "old park", "road", "")
    assert parts("5 rue Victor Hugo, 75001 Paris", "france") == ("5", "victor hugo", "rue", "75001")
    assert parts("5 rue Victor Schoelcher, 75001 Paris", "france") == ("5", "victor schoelcher", "rue", "75001")
    towards = [addresses.parse(t, "us").towards for t in ("12 East Park Road", "12 West Park Road", "Park Rd W 12", "12 Park Road")]
    assert towards == ["east", "west", "west", ""]
    assert parts("Hauptstraße 12, 10115 Berlin", "") == parts("Hauptstr. 12, 10115 Berlin", "") == ("12", "haupt", "strasse", "10115")
    # A postal code beside the street is no house number while a short number or no other code is there.
    assert parts("Alnagar NT 24333 Rovepe Lane 24") == ("24", "rovepe", "lane", "24333")
    assert parts("24333 Rovepe Lane")[0] == ""


def test_places_before_the_street_are_told_from_its_name(spark):
    rows = [(f"a{i}", f"{10 + i} Rovepe Road, Alnagar, 11100{i}", "India") for i in range(6)] + [(f"m{i}", f"{10 + i} Martin Luther King Road, Belpur, 22200{i}", "India") for i in range(6)]
    rows += [("x", "Alnagar Rovepe Road 12", "India"), ("y", "Martin Luther King Road 13 Belpur", "India"), ("n", "5 North Gava Road, Alnagar, 111001", "India"), ("s", "5 South Gava Road, Alnagar, 111001", "India")]
    df = spark.createDataFrame(rows, "entity_id string, business_address string, country string")
    got = {tuple(r) for r in gazetteer.same_location_pairs(df, "entity_id", "business_address", "country").collect()}
    assert got == {("a2", "x"), ("m3", "y")}
