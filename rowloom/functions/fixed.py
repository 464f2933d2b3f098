"""Fixed values of the record model: they must be these for results to be right. Longer tables are made from a rule."""

from __future__ import annotations

# Texts that stand in for a missing value.
PLACEHOLDERS = (
    "n/a", "na", "n.a.", "none", "null", "nil", "nan", "#n/a", "#value!", "#ref!", "#div/0!", "#name?", "#null!", "#num!",
    "-", "--", "---", "?", "??", "unknown", "not available", "not applicable", "tbd", "undefined", "blank", "empty",
)
# Words of test records, and words that may stand beside them.
TEST_WORDS = ("test", "testing", "tester", "asdf", "asdfgh", "qwerty", "dummy", "sample", "lorem", "ipsum", "xxx", "zzz", "foo", "bar", "abc", "aaa")
TEST_COMPANIONS = ("user", "name", "person")
# Local parts and whole addresses that are no mailbox of anybody.
PLACEHOLDER_LOCALS = ("noemail", "no-email", "no.email", "none", "na", "nobody", "noone", "no", "test", "asdf", "fake", "email", "donotreply", "do-not-reply", "noreply", "no-reply", "unknown")
PLACEHOLDER_MAILS = ("test@test.com", "email@email.com", "a@a.com", "x@x.com")
# Frequent misspellings of large mailbox domains.
DOMAIN_TYPOS = {
    "gmial.com": "gmail.com", "gmai.com": "gmail.com", "gmal.com": "gmail.com", "gmail.co": "gmail.com", "gmail.con": "gmail.com", "gmaill.com": "gmail.com", "gnail.com": "gmail.com", "gamil.com": "gmail.com",
    "yaho.com": "yahoo.com", "yahooo.com": "yahoo.com", "yahoo.co": "yahoo.com", "yahoo.con": "yahoo.com", "hotmial.com": "hotmail.com", "hotmal.com": "hotmail.com", "hotmail.co": "hotmail.com", "hotmail.con": "hotmail.com",
    "outlok.com": "outlook.com", "outloo.com": "outlook.com", "outlook.co": "outlook.com", "iclod.com": "icloud.com", "icloud.co": "icloud.com", "aol.co": "aol.com", "comcast.ner": "comcast.net",
}
# Mailbox providers that deliver user+tag to user; two of them ignore dots.
PLUS_TAG_DOMAINS = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "me.com", "mac.com", "fastmail.com", "protonmail.com", "proton.me")
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")
# Words of legal forms.
LEGAL_FORMS = ("inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "ag", "sa", "sas", "srl", "bv", "nv", "pty", "pllc", "pc", "the")
# Parameters of URLs that only track, besides all that begin with utm_.
TRACKING = ("ref", "fbclid", "gclid", "mc_eid", "mc_cid")
# Titles, suffixes and particles of names in comparisons; suffixes and particles as they are written out.
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "madam")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "esq")
PARTICLES = ("de", "del", "della", "la", "le", "van", "von", "der", "den", "da", "di", "du", "dos", "das", "bin", "ibn", "al", "el", "st")
WRITTEN_SUFFIXES = {"jr": "Jr.", "sr": "Sr.", "ii": "II", "iii": "III", "iv": "IV", "v": "V", "phd": "PhD", "md": "MD", "esq": "Esq."}
WRITTEN_PARTICLES = ("de", "del", "della", "la", "le", "van", "von", "der", "den", "da", "di", "du", "dos", "das", "bin", "ibn")
# Street types and directions in comparisons.
STREET_TYPES = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "lane": "ln", "boulevard": "blvd", "court": "ct", "place": "pl", "circle": "cir", "highway": "hwy", "parkway": "pkwy",
    "terrace": "ter", "trail": "trl", "square": "sq", "way": "way", "loop": "loop",
}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
# Street types and unit words as they are written out.
WRITTEN_TYPES = {
    "street": "St", "st": "St", "str": "St", "avenue": "Ave", "ave": "Ave", "av": "Ave", "road": "Rd", "rd": "Rd", "drive": "Dr", "dr": "Dr", "lane": "Ln", "ln": "Ln", "boulevard": "Blvd", "blvd": "Blvd",
    "court": "Ct", "ct": "Ct", "place": "Pl", "pl": "Pl", "circle": "Cir", "cir": "Cir", "highway": "Hwy", "hwy": "Hwy", "parkway": "Pkwy", "pkwy": "Pkwy", "terrace": "Ter", "ter": "Ter", "trail": "Trl", "trl": "Trl",
    "square": "Sq", "sq": "Sq", "way": "Way", "loop": "Loop", "expressway": "Expy", "freeway": "Fwy", "crossing": "Xing", "point": "Pt", "plaza": "Plz", "mountain": "Mtn", "heights": "Hts",
}
WRITTEN_UNITS = {"apartment": "Apt", "apt": "Apt", "suite": "Ste", "ste": "Ste", "unit": "Unit", "building": "Bldg", "bldg": "Bldg", "floor": "Fl", "fl": "Fl", "room": "Rm", "rm": "Rm"}
# Names and codes of US states and territories.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI",
    "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND",
    "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "puerto rico": "PR", "guam": "GU", "virgin islands": "VI", "american samoa": "AS", "northern mariana islands": "MP",
}
# Roles that a column may have once; others are sets, identifiers or not compared.
SINGLE_ROLES = (
    "address", "mailing_address", "building_name", "house_number", "street", "unit", "po_box", "neighborhood", "district", "city", "county", "region", "country", "country_code", "postal_code", "latitude", "longitude",
    "name", "first_name", "last_name", "url",
)
ROLES = (*SINGLE_ROLES, "phone", "email", "identifier", "other", "ignore")
PLACE_ROLES = ("building_name", "house_number", "street", "unit", "po_box", "neighborhood", "district", "city", "county", "region", "country", "country_code")
LOCALITY_ROLES = ("postal_code", "city", "county", "region", "country_code", "country")
# Weight of each field in the score, thresholds of the two degrees of strictness, factor of a given-name relation.
WEIGHTS = {"identifier": 0.30, "phone": 0.32, "email": 0.28, "address": 0.20, "mailing_address": 0.10, "name": 0.15, "region": 0.05, "url": 0.20}
STRICTNESS = {"conservative": (0.95, 0.75), "balanced": (0.90, 0.70)}
GIVEN_FACTOR = {"same": 1.0, "nickname": 0.97, "similar": 0.95, "initial": 0.75}

#: own table, short and pet forms of given names with the full names they may stand for; callers may pass their own
SHORT_NAMES = {
    "abby": "abigail", "al": "albert alfred alexander", "alex": "alexander alexandra", "andy": "andrew", "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "katherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel",
    "dave": "david", "debbie": "deborah", "dick": "richard", "don": "donald", "dot": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "frank": "francis", "fred": "frederick alfred", "gene": "eugene",
    "greg": "gregory", "hal": "harold", "hank": "henry", "harry": "harold henry", "jack": "john", "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph",
    "jon": "jonathan john", "josh": "joshua", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "liam": "william", "liz": "elizabeth", "maggie": "margaret",
    "matt": "matthew", "meg": "margaret", "mike": "michael", "nate": "nathaniel", "nick": "nicholas", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond",
    "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "sandy": "alexander alexandra", "steve": "stephen", "steven": "stephen", "sue": "susan", "ted": "theodore edward", "tim": "timothy",
    "tom": "thomas", "tony": "anthony", "vicky": "victoria", "vince": "vincent", "walt": "walter", "will": "william", "zach": "zachary", "catherine": "katherine", "kathryn": "katherine", "phillip": "philip", "debra": "deborah",
}
