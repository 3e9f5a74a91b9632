"""Districts, adjacency, place rules, notes and lookup tables."""

# --- fixed values: district centres (name, lat, lng, province), in tie-break order --------------
DISTRICTS = [
    ("Colombo", 6.9271, 79.8612, "Western"),
    ("Gampaha", 7.0873, 80.0144, "Western"),
    ("Kalutara", 6.5854, 79.9607, "Western"),
    ("Kandy", 7.2906, 80.6337, "Central"),
    ("Matale", 7.4675, 80.6234, "Central"),
    ("Nuwara Eliya", 6.9497, 80.7891, "Central"),
    ("Galle", 6.0535, 80.2210, "Southern"),
    ("Matara", 5.9549, 80.5550, "Southern"),
    ("Hambantota", 6.1248, 81.1185, "Southern"),
    ("Jaffna", 9.6615, 80.0255, "Northern"),
    ("Kilinochchi", 9.3803, 80.3992, "Northern"),
    ("Mannar", 8.9810, 79.9044, "Northern"),
    ("Vavuniya", 8.7542, 80.4982, "Northern"),
    ("Mullaitivu", 9.2673, 80.8143, "Northern"),
    ("Batticaloa", 7.7170, 81.7010, "Eastern"),
    ("Ampara", 7.2912, 81.6724, "Eastern"),
    ("Trincomalee", 8.5874, 81.2152, "Eastern"),
    ("Kurunegala", 7.4863, 80.3647, "North Western"),
    ("Puttalam", 8.0362, 79.8283, "North Western"),
    ("Anuradhapura", 8.3114, 80.4037, "North Central"),
    ("Polonnaruwa", 7.9403, 81.0000, "North Central"),
    ("Badulla", 6.9934, 81.0550, "Uva"),
    ("Moneragala", 6.8724, 81.3507, "Uva"),
    ("Ratnapura", 6.6828, 80.3992, "Sabaragamuwa"),
    ("Kegalle", 7.2513, 80.3464, "Sabaragamuwa"),
]
# --- fixed values: alert map positions (name, lat, lng), in match order --------------------------
ALERT_POSITIONS = [
    ("Colombo", 6.9271, 79.8612),
    ("Gampaha", 7.0873, 80.0144),
    ("Kalutara", 6.5854, 79.9607),
    ("Kandy", 7.2906, 80.6337),
    ("Matale", 7.4675, 80.6234),
    ("Nuwara Eliya", 6.9697, 80.7891),
    ("Galle", 6.0535, 80.2210),
    ("Matara", 5.9549, 80.5550),
    ("Hambantota", 6.1248, 81.1185),
    ("Jaffna", 9.6615, 80.0255),
    ("Kilinochchi", 9.3803, 80.3995),
    ("Mannar", 8.9810, 79.9044),
    ("Vavuniya", 8.7542, 80.4982),
    ("Mullaitivu", 9.2671, 80.8143),
    ("Batticaloa", 7.7310, 81.6747),
    ("Ampara", 7.2912, 81.6747),
    ("Trincomalee", 8.5873, 81.2152),
    ("Kurunegala", 7.4863, 80.3647),
    ("Puttalam", 8.0362, 79.8283),
    ("Anuradhapura", 8.3114, 80.4037),
    ("Polonnaruwa", 7.9403, 81.0188),
    ("Badulla", 6.9934, 81.0550),
    ("Moneragala", 6.8724, 81.3507),
    ("Ratnapura", 6.6828, 80.3992),
    ("Kegalle", 7.2513, 80.3464),
]
COUNTRY_CENTRE = ("Sri Lanka", 7.8731, 80.7718)
ALERT_RED = ["red", "extreme", "evacuate", "immediate"]
ALERT_AMBER = ["warning", "alert", "amber"]
ALERT_RADIUS = {"Red": 15000, "Amber": 10000, "Yellow": 5000}
BULLETIN_CHARS = 200

# --- fixed values: district neighbours, in visiting order -----------------------------------------
NEIGHBOURS = {
    "colombo": ["gampaha", "kalutara", "kegalle"],
    "gampaha": ["colombo", "puttalam", "kurunegala", "kegalle"],
    "kalutara": ["colombo", "ratnapura", "galle", "kegalle"],
    "kandy": ["matale", "kegalle", "nuwara eliya", "badulla", "kurunegala"],
    "matale": ["kandy", "kurunegala", "anuradhapura", "polonnaruwa", "badulla"],
    "nuwara eliya": ["kandy", "badulla", "ratnapura", "kegalle"],
    "galle": ["kalutara", "matara", "ratnapura"],
    "matara": ["galle", "hambantota", "ratnapura"],
    "hambantota": ["matara", "moneragala", "ratnapura", "ampara"],
    "jaffna": ["kilinochchi"],
    "kilinochchi": ["jaffna", "mannar", "mullaitivu"],
    "mannar": ["kilinochchi", "mullaitivu", "anuradhapura", "puttalam"],
    "vavuniya": ["mannar", "mullaitivu", "anuradhapura"],
    "mullaitivu": ["kilinochchi", "mannar", "vavuniya", "trincomalee"],
    "batticaloa": ["polonnaruwa", "ampara"],
    "ampara": ["batticaloa", "moneragala", "badulla", "hambantota"],
    "trincomalee": ["mullaitivu", "anuradhapura", "polonnaruwa", "batticaloa"],
    "kurunegala": ["puttalam", "gampaha", "kegalle", "kandy", "matale", "anuradhapura"],
    "puttalam": ["mannar", "anuradhapura", "kurunegala", "gampaha"],
    "anuradhapura": [
        "puttalam", "mannar", "vavuniya", "trincomalee", "polonnaruwa", "matale", "kurunegala",
    ],
    "polonnaruwa": ["anuradhapura", "trincomalee", "batticaloa", "matale"],
    "badulla": ["matale", "kandy", "nuwara eliya", "ratnapura", "moneragala", "ampara"],
    "moneragala": ["badulla", "ampara", "hambantota", "ratnapura"],
    "ratnapura": [
        "kegalle", "kalutara", "galle", "matara", "hambantota", "moneragala", "badulla",
        "nuwara eliya",
    ],
    "kegalle": [
        "gampaha", "colombo", "kalutara", "ratnapura", "nuwara eliya", "kandy", "kurunegala",
    ],
}

# --- fixed values: map features ----------------------------------------------------------------------
FEATURE_TAGS = ["tourism", "historic", "leisure", "natural"]
FEATURE_AMENITIES = ["place_of_worship", "restaurant", "cafe", "hotel", "scenic_viewpoint"]
FEATURE_SETTLEMENTS = ["town", "village", "island"]
FEATURE_LIMIT = 15_000
NAME_COLUMNS = [
    "Beach_Name", "River_Name", "Waterfall_Name", "Lake_Name", "Viewpoint_Name",
    "National_Park", "Name", "Place_Name",
]
CATALOG_COLUMNS = [
    "id", "name", "category_id", "district_id", "province_id",
    "lat", "lng", "description", "best_time_to_visit", "ticket_price",
    "opening_hours", "activities", "tourist_popularity", "budget_category",
    "parking_avail", "toilets", "food_nearby", "wheelchair_access",
    "camping_allowed", "family_friendly", "safety_level", "wildlife_hazard",
    "guide_required", "rain_sensitivity", "monsoon_note", "mobile_signal",
    "road_condition", "Height_m", "Length_km", "Surfing",
]
SAFETY_LEVELS = ["Safe", "Moderate", "Dangerous"]
POPULARITY_LEVELS = ["High", "Medium", "Low"]

# --- fixed values: attribute defaults and category rules ----------------------------------------------
PLACE_DEFAULTS = {
    "best_time_to_visit": "December to March",
    "ticket_price": "Free",
    "parking_avail": "yes",
    "toilets": "yes",
    "food_nearby": "yes",
    "wheelchair_access": "no",
    "camping_allowed": "no",
    "safety_level": "Safe",
    "wildlife_hazard": "None",
    "guide_required": "no",
    "rain_sensitivity": "Safe",
    "monsoon_note": "None",
    "mobile_signal": "Good",
    "road_condition": "Paved",
    "activities": "Sightseeing, Photography",
    "tourist_popularity": "Medium",
    "budget_category": "Free",
    "Height_m": "0",
    "Length_km": "0",
}
# (rule, words contained in the category, categories equal to)
CATEGORY_RULES = [
    ("beach", ["beach"], []),
    ("mountain", ["peak", "mountain"], ["hiking", "volcano", "rock", "ridge"]),
    ("water", ["water"], ["cascade"]),
    ("worship", ["worship"], ["temple", "monastery", "church", "mosque", "kovil"]),
    ("wild", [], ["nature_reserve", "national_park", "zoo", "aquarium", "forest"]),
    ("dining", [], ["restaurant", "cafe", "bar", "fast_food"]),
]
RULE_VALUES = {
    "beach": {
        "activities": "Swimming, Sunbathing, Photography, Sunset Watching",
        "tourist_popularity": "High",
        "budget_category": "Free",
    },
    "mountain": {
        "best_time_to_visit": "January to April",
        "parking_avail": "no",
        "toilets": "no",
        "food_nearby": "no",
        "camping_allowed": "yes",
        "safety_level": "Moderate",
        "road_condition": "Trekking",
        "activities": "Hiking, Trekking, Sunrise Watching, Photography",
        "tourist_popularity": "Medium",
    },
    "water": {
        "best_time_to_visit": "September to January",
        "parking_avail": "no",
        "toilets": "no",
        "safety_level": "Moderate",
        "rain_sensitivity": "Dangerous during heavy rain",
        "activities": "Sightseeing, Swimming, Photography",
        "tourist_popularity": "High",
    },
    "worship": {
        "best_time_to_visit": "All year round",
        "ticket_price": "Free (Donations welcome)",
        "activities": "Cultural Exploration, Sightseeing, Worship",
        "tourist_popularity": "High",
    },
    "wild": {
        "best_time_to_visit": "December to April",
        "ticket_price": "2500 LKR",
        "safety_level": "Moderate",
        "wildlife_hazard": "Elephant and wild animal encounters possible",
        "road_condition": "4WD Required",
        "activities": "Wildlife Safari, Photography, Bird Watching",
        "tourist_popularity": "High",
        "budget_category": "Moderate",
    },
    "dining": {"budget_category": "Budget", "activities": "Dining, Socializing"},
}
BEACH_LATITUDE = 7.5
BEACH_SEASONS = ("December to April", "May to September")  # south of the latitude, north of it
POPULAR_NAMES = [
    "sigiriya", "ella", "galle", "kandy", "yala", "udawalawe", "mirissa", "hikkaduwa",
    "unawatuna", "pinnawala", "adams peak", "sripada", "horton plains",
]
COSTLY_NAMES = ["sigiriya", "galle fort"]
COSTLY_VALUES = {"ticket_price": "4500 LKR", "budget_category": "Expensive"}
DESCRIPTIONS = [
    "{name} is a beautiful {category} located in the {district} district of the {province} province, Sri Lanka. It represents a highly recommended stop for travelers interested in exploring the unique local charm and sightseeing spots of the region.",
    "Located in {district} ({province} Province), {name} is a popular {category} offering visitors a glimpse into Sri Lanka's local culture, breathtaking views, and rich natural surroundings.",
    "{name} is a scenic {category} in the {district} district, Sri Lanka. Known for its pleasant climate and visual appeal, it is a perfect spot for photography, adventure, and relaxation.",
    "A beautiful landmark found in {district}, {province} Province, {name} stands as an important {category} attraction. It is a must-visit location for anyone exploring the travel highlights of Sri Lanka.",
]

# --- fixed values: budget estimate (LKR) -----------------------------------------------------------------
BUDGET_DEFAULT_ENTRY = 500
BUDGET_FOOD = {"High": 1100, "other": 600}
BUDGET_TRANSPORT = {"rough": 2200, "other": 500}
BUDGET_LEVELS = (1500, 5000)
ROUGH_ROADS = ["off-road", "rough", "difficult"]

# --- fixed values: names that span districts; first key contained in the name wins -------------------------
SPANS = [
    ("mahaweli", ["Nuwara Eliya", "Kandy", "Matale", "Polonnaruwa", "Trincomalee"]),
    ("kelani", ["Nuwara Eliya", "Kegalle", "Colombo"]),
    ("kalu", ["Ratnapura", "Kalutara"]),
    ("gin", ["Ratnapura", "Galle"]),
    ("walawe", ["Ratnapura", "Hambantota"]),
    ("deduru", ["Kurunegala", "Puttalam"]),
    ("a9 highway", ["Colombo", "Gampaha", "Kurunegala", "Anuradhapura", "Vavuniya", "Kilinochchi", "Jaffna"]),
    ("a1 highway", ["Colombo", "Kalutara", "Galle", "Matara", "Hambantota"]),
]
# The second dictionary version uses shorter road keys.
SHORT_ROADS = {"a9 highway": "a9", "a1 highway": "a1"}
PLACE_NOTES = [
    ("kandy lake", "Kandy Lake (නුවර වැව) is in Kandy city, Kandy District. NOT in Nuwara Eliya."),
    ("නුවර වැව", "නුවර වැව = Kandy Lake. මහනුවර (Kandy) දිස්ත්‍රික්කයේ ය. නුවරඑළිය නොවේ."),
    ("galle face", "Galle Face Green is in Colombo. Not in Galle city."),
    ("victoria", "Victoria Reservoir = Kandy District. Victoria Park = Nuwara Eliya. Different places."),
    ("gregory", "Lake Gregory = Nuwara Eliya. Not the same as Kandy Lake (නුවර වැව)."),
    ("sigiriya", "Sigiriya is in Matale District, not Polonnaruwa District."),
    ("pidurutalagala", "Pidurutalagala (highest peak) is in Nuwara Eliya District."),
    ("adam", "Adam's Peak (ශ්‍රී පාද) is in Ratnapura District, not Nuwara Eliya."),
    ("රාවණා", "රාවණා ඇල්ල (Ravana Falls) Ella, Badulla District ලේ ඇත. Ravana is also a historical figure — different context."),
    ("ella", "Ella town is in Badulla District (Uva Province). Not in Nuwara Eliya Province."),
    ("anuradhapura", "Anuradhapura is both a district AND a city. Ancient lakes (Tissa Wewa, Nuwara Wewa) are inside the city."),
    ("trincomalee", "Trincomalee is in Eastern Province. Not to be confused with Trincomalee road in Kandy."),
    ("හෝර්ටන්", "Horton Plains is in Nuwara Eliya District. Not related to Horton Place, Colombo."),
    ("horton", "Horton Plains National Park is in Nuwara Eliya District. Horton Place is a road in Colombo 7."),
]
# The second dictionary version, with its own wording.
SHORT_PLACE_NOTES = [
    ("kandy lake", "Kandy Lake (නුවර වැව) is in Kandy city, NOT Nuwara Eliya. Do not confuse with any lake in Nuwara Eliya."),
    ("නුවර වැව", "නුවර වැව = Kandy Lake. මහනුවර (Kandy) දිස්ත්‍රික්කයේ ය. නුවරඑළිය (Nuwara Eliya) නොවේ."),
    ("galle", "Galle city is in Galle District, Southern Province. Not to be confused with Galle Face in Colombo."),
    ("galle face", "Galle Face Green is in Colombo, Colombo District. Not in Galle city or Galle District."),
    ("victoria", "Victoria Reservoir is in Kandy District. Victoria Park is in Nuwara Eliya. They are different."),
    ("gregory", "Lake Gregory is in Nuwara Eliya District. Not the same as Kandy Lake."),
    ("sigiriya", "Sigiriya Rock Fortress is in Matale District, not Polonnaruwa District."),
    ("anuradhapura", "Anuradhapura is a district AND a city. The ancient lakes (Tissa Wewa, Nuwara Wewa) are within Anuradhapura city."),
]
HISTORY_NOTES = [
    ("parakramabahu", "ශ්‍රී ලංකා ඉතිහාසයේ 'පරාක්‍රමබාහු' නමින් රජවරු 12ක් ඉදලා ඇත. / Sri Lanka had 12 kings named Parakramabahu."),
    ("vijayabahu", "ශ්‍රී ලංකා ඉතිහාසයේ 'විජයබාහු' නමින් රජවරු කිහිප දෙනෙකු ඉදලා ඇත. / Multiple kings named Vijayabahu in Sri Lankan history."),
]

# --- fixed values: preference diagnostics categories, in match order ---------------------------------------
PROMPT_CATEGORIES = [
    ("Waterfall", ["waterfall", "ඇල්ල", "දියඇලි"]),
    ("Beach", ["beach", "වෙරළ", "මුහුද"]),
    ("Historical", ["history", "පැරණි", "ancient", "temple", "කෝවිල", "විහාරය", "sigiriya", "ruins"]),
    ("National Park", ["national park", "wildlife", "සතුන්", "වනෝද්‍යාන"]),
    ("Mountain/Viewpoint", ["mountain", "hiking", "කන්ද", "නැරඹුම්"]),
]

# --- fixed values: travel lookups ------------------------------------------------------------------------------
WEATHER_PLACES = [
    ("colombo", 6.9271, 79.8612),
    ("kandy", 7.2906, 80.6337),
    ("galle", 6.0535, 80.2210),
    ("nuwara eliya", 6.9497, 80.7891),
    ("jaffna", 9.6615, 80.0255),
    ("sigiriya", 7.9570, 80.7600),
    ("ella", 6.8719, 81.0478),
    ("trincomalee", 8.5873, 81.2152),
    ("negombo", 7.2089, 79.8358),
    ("anuradhapura", 8.3114, 80.4037),
    ("polonnaruwa", 7.9403, 81.0028),
    ("yala", 6.3824, 81.5208),
]
WEATHER_CODES = [
    (0, "Clear sky ☀️"),
    (1, "Mainly clear 🌤️"),
    (2, "Partly cloudy ⛅"),
    (3, "Overcast ☁️"),
    (45, "Foggy 🌫️"),
    (48, "Depositing rime fog 🌫️"),
    (51, "Light drizzle 🌧️"),
    (53, "Moderate drizzle 🌧️"),
    (55, "Dense drizzle 🌧️"),
    (61, "Slight rain 🌧️"),
    (63, "Moderate rain 🌧️"),
    (65, "Heavy rain 🌧️"),
    (71, "Slight snow fall ❄️"),
    (73, "Moderate snow fall ❄️"),
    (75, "Heavy snow fall ❄️"),
    (80, "Slight rain showers 🌦️"),
    (81, "Moderate rain showers 🌦️"),
    (82, "Violent rain showers ⛈️"),
    (95, "Thunderstorm ⛈️"),
    (96, "Thunderstorm with slight hail ⛈️"),
    (99, "Thunderstorm with heavy hail ⛈️"),
]
WEATHER_DEFAULT = "Cloudy ☁️"
DISTANCES = [
    ("colombo", "kandy", "115 km", "3 hours 15 minutes via A1 highway / Central Expressway"),
    ("colombo", "galle", "125 km", "1 hour 45 minutes via Southern Expressway"),
    ("colombo", "nuwara eliya", "165 km", "4 hours 45 minutes via Avissawella-Hatton road"),
    ("colombo", "jaffna", "390 km", "6 hours 45 minutes via A9 highway"),
    ("colombo", "sigiriya", "175 km", "3 hours 50 minutes via A6 highway"),
    ("colombo", "ella", "200 km", "5 hours via Southern Expressway and Welimada, or 9 hours scenic train"),
    ("kandy", "nuwara eliya", "75 km", "2 hours 30 minutes via Gampola-Nuwara Eliya road"),
    ("kandy", "ella", "135 km", "3 hours 45 minutes via Badulla road"),
    ("galle", "ella", "190 km", "3 hours 15 minutes via Southern Expressway to Mattala/Hambantota"),
    ("kandy", "sigiriya", "90 km", "2 hours 15 minutes via Matale-Dambulla road"),
    ("sigiriya", "trincomalee", "100 km", "2 hours via Habarana-Trincomalee road"),
]
CURRENCY_RATES = [("usd", 302.50), ("eur", 328.20), ("gbp", 385.80), ("aud", 201.10), ("inr", 3.62)]
SINHALA_TERMS = [
    ("beaches", "වෙරළ තීරයක්"),
    ("beach", "වෙරළක්"),
    ("waterfalls", "දියඇල්ලක්"),
    ("waterfall", "දියඇල්ලක්"),
    ("mountains", "කඳු වැටියක්"),
    ("mountain", "කන්දක්"),
    ("temples", "ඓතිහාසික විහාරස්ථානයක්"),
    ("temple", "විහාරස්ථානයක්"),
    ("parks", "ජාතික උද්‍යානයක්"),
    ("park", "උද්‍යානයක්"),
    ("lakes", "වැවක්/ජලාශයක්"),
    ("lake", "වැවක්"),
    ("safe", "සම්පූර්ණයෙන්ම ආරක්ෂිතයි"),
    ("moderate", "සාමාන්‍ය ආරක්ෂිතයි"),
    ("dangerous", "අවදානම් සහිතයි"),
    ("yes", "පහසුකම් ඇත"),
    ("no", "පහසුකම් නොමැත"),
    ("free", "නොමිලේ"),
    ("paved", "කාපට් කරන ලද හොඳ තත්ත්වයේ මාර්ගයකි"),
    ("4wd", "4WD වාහන පමණක් යා හැකි දුෂ්කර මාර්ගයකි"),
    ("sand", "වැලි සහිත මාර්ගයකි"),
    ("good", "හොඳින් සංඥා ඇත"),
    ("weak", "සංඥා දුර්වලයි"),
    ("none", "සංඥා නොමැත"),
]
UNKNOWN_TERM = "නොදනී"
