"""Small word lists behind the generators.

The lists of the first block are fixed values: the status-like generators must
draw from exactly these.  The second block is our own filler vocabulary.
"""

# --- fixed values -----------------------------------------------------------
STATUS = ("active", "inactive", "pending", "archived")
CATEGORY = ("general", "premium", "basic", "enterprise")
ROLE = ("admin", "user", "editor", "viewer")
PRIORITY = ("low", "medium", "high", "critical")
LOCALE = ("en_US", "en_GB", "de_DE", "fr_FR", "es_ES")
TIMEZONE = ("UTC", "US/Eastern", "US/Pacific", "Europe/London")
MIME_TYPE = ("text/plain", "application/json", "image/png")

# --- filler vocabulary ------------------------------------------------------
FIRST_NAMES = (
    "Ada", "Alan", "Amara", "Anil", "Bea", "Boris", "Carla", "Chen", "Dario", "Dina",
    "Edith", "Emil", "Farah", "Felix", "Grace", "Goran", "Hana", "Hugo", "Ines", "Ivan",
    "Jana", "Jonas", "Kaito", "Kira", "Lena", "Luis", "Maya", "Milo", "Nadia", "Noah",
    "Olga", "Oscar", "Priya", "Pavel", "Quinn", "Rosa", "Ravi", "Sara", "Simon", "Tara",
    "Tomas", "Uma", "Victor", "Vera", "Wanda", "Xavier", "Yara", "Yusuf", "Zoe", "Zane",
)
LAST_NAMES = (
    "Abbott", "Alvarez", "Bauer", "Becker", "Carter", "Costa", "Dahl", "Dubois", "Ellis",
    "Eriksen", "Fischer", "Fontaine", "Garcia", "Gupta", "Hansen", "Hughes", "Ivanov",
    "Ito", "Jensen", "Jones", "Kaur", "Keller", "Lopez", "Larsen", "Meyer", "Moreau",
    "Novak", "Nguyen", "Olsen", "Ortiz", "Patel", "Petrov", "Quiroga", "Rossi", "Ruiz",
    "Schmidt", "Silva", "Tanaka", "Turner", "Unger", "Vega", "Vogel", "Walker", "Weber",
    "Xu", "Yamada", "Young", "Zeller", "Zhang", "Zimmer",
)
WORDS = (
    "amber", "anchor", "autumn", "basil", "beacon", "birch", "bridge", "canyon", "cedar",
    "cloud", "copper", "coral", "crystal", "delta", "ember", "falcon", "fern", "field",
    "forest", "garden", "glacier", "granite", "harbor", "hazel", "island", "ivory", "jade",
    "juniper", "lagoon", "lantern", "maple", "marble", "meadow", "mist", "north", "oak",
    "ocean", "olive", "opal", "orchard", "pearl", "pebble", "pine", "prairie", "quartz",
    "raven", "reef", "river", "sable", "sage", "shadow", "silver", "slate", "stone",
    "summit", "thistle", "timber", "valley", "willow", "winter",
)
GENDERS = ("Female", "Male", "Nonbinary", "Undisclosed")
STREET_TYPES = ("Street", "Avenue", "Road", "Lane", "Drive", "Court", "Way", "Place")
COUNTRIES = (
    ("AR", "Argentina"), ("AU", "Australia"), ("BR", "Brazil"), ("CA", "Canada"),
    ("CL", "Chile"), ("CN", "China"), ("DE", "Germany"), ("DK", "Denmark"),
    ("EG", "Egypt"), ("ES", "Spain"), ("FR", "France"), ("GB", "United Kingdom"),
    ("IE", "Ireland"), ("IN", "India"), ("IT", "Italy"), ("JP", "Japan"),
    ("KE", "Kenya"), ("KR", "South Korea"), ("MX", "Mexico"), ("NG", "Nigeria"),
    ("NL", "Netherlands"), ("NO", "Norway"), ("NZ", "New Zealand"), ("PE", "Peru"),
    ("PL", "Poland"), ("PT", "Portugal"), ("SE", "Sweden"), ("TR", "Turkey"),
    ("US", "United States"), ("ZA", "South Africa"),
)
CURRENCIES = (
    "ARS", "AUD", "BRL", "CAD", "CHF", "CNY", "DKK", "EUR", "GBP", "INR",
    "JPY", "KRW", "MXN", "NOK", "NZD", "PLN", "SEK", "TRY", "USD", "ZAR",
)
MAIL_DOMAINS = ("example.com", "example.org", "example.net", "mail.example", "post.example")
USER_AGENTS = (
    "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/128.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) AppleWebKit/605.1.15 Version/17.5 Safari/605.1.15",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1.15 Mobile/15E148",
    "curl/8.8.0",
)
# State capitals with their state and a zip code of the city.
PLACES = (
    ("Montgomery", "AL", "36104"), ("Juneau", "AK", "99801"), ("Phoenix", "AZ", "85004"),
    ("Little Rock", "AR", "72201"), ("Sacramento", "CA", "95814"), ("Denver", "CO", "80202"),
    ("Hartford", "CT", "06103"), ("Dover", "DE", "19901"), ("Tallahassee", "FL", "32301"),
    ("Atlanta", "GA", "30303"), ("Honolulu", "HI", "96813"), ("Boise", "ID", "83702"),
    ("Springfield", "IL", "62701"), ("Indianapolis", "IN", "46204"), ("Des Moines", "IA", "50309"),
    ("Topeka", "KS", "66603"), ("Frankfort", "KY", "40601"), ("Baton Rouge", "LA", "70802"),
    ("Augusta", "ME", "04330"), ("Annapolis", "MD", "21401"), ("Boston", "MA", "02108"),
    ("Lansing", "MI", "48933"), ("Saint Paul", "MN", "55102"), ("Jackson", "MS", "39201"),
    ("Jefferson City", "MO", "65101"), ("Helena", "MT", "59601"), ("Lincoln", "NE", "68508"),
    ("Carson City", "NV", "89701"), ("Concord", "NH", "03301"), ("Trenton", "NJ", "08608"),
    ("Santa Fe", "NM", "87501"), ("Albany", "NY", "12207"), ("Raleigh", "NC", "27601"),
    ("Bismarck", "ND", "58501"), ("Columbus", "OH", "43215"), ("Oklahoma City", "OK", "73102"),
    ("Salem", "OR", "97301"), ("Harrisburg", "PA", "17101"), ("Providence", "RI", "02903"),
    ("Columbia", "SC", "29201"), ("Pierre", "SD", "57501"), ("Nashville", "TN", "37219"),
    ("Austin", "TX", "78701"), ("Salt Lake City", "UT", "84111"), ("Montpelier", "VT", "05602"),
    ("Richmond", "VA", "23219"), ("Olympia", "WA", "98501"), ("Charleston", "WV", "25301"),
    ("Madison", "WI", "53703"), ("Cheyenne", "WY", "82001"),
)
