"""Question, answer and pair templates; `{slot}` names are filled from columns."""

# --- fixed values: budget phrases -----------------------------------------------------------------
BUDGET_PHRASES = {
    "entry_si": ("නොමිලේ (Free)", "ප්‍රවේශ ගාස්තුව {ticket_str} කි."),
    "entry_en": ("Free of charge", "Entry fee is {ticket_str}."),
    "food_si": (
        "ප්‍රදේශයේ ආහාර මිල තරමක් වැඩි විය හැක (එක් අයෙකුට වේලක් සඳහා රු. 800 - 1500 පමණ)",
        "සාමාන්‍ය දේශීය අවන්හල් වලින් ආහාර ලබා ගත හැක (එක් අයෙකුට වේලක් සඳහා රු. 400 - 800 පමණ)",
    ),
    "food_en": (
        "Food costs nearby can be slightly high (approx. LKR 800 - 1500 per meal per person)",
        "Standard local eateries are available (approx. LKR 400 - 800 per meal per person)",
    ),
    "transport_si": (
        "මාර්ගය අපහසු බැවින් ත්‍රීවීල් (Tuk-tuk) හෝ 4WD රථයක් සඳහා රු. 1500 - 3000 අතර මුදලක් වැය විය හැක.",
        "ප්‍රධාන මාර්ගයේ සිට බස් රථයකින් හෝ ත්‍රීවීල් (Tuk-tuk) රථයකින් රු. 300 - 800 අතර මුදලකට ළඟා විය හැක.",
    ),
    "transport_en": (
        "Due to rough road conditions, a Tuk-tuk or 4WD hire from the nearest town may cost LKR 1500 - 3000.",
        "Easily accessible via bus or a short Tuk-tuk ride from the nearest town (approx. LKR 300 - 800).",
    ),
}
BUDGET_LEVEL_SI = ["අඩු වියදම් (Budget-friendly)", "මධ්‍යම වියදම් (Mid-range)", "ඉහළ වියදම් (High budget / Premium)"]
BUDGET_LEVEL_EN = ["Budget-friendly / Low cost", "Mid-range", "High budget / Expensive"]
POPULARITY_SI = {"High": "ඉතා ජනප්‍රිය", "Medium": "මධ්‍යම ජනප්‍රිය", "Low": "අඩු ජනප්‍රිය"}

# --- fixed values: yes/no phrases -------------------------------------------------------------------
CHOICES = {
    "free_si": ("ඔව්, {name} නොමිලේ (Free) නැරඹිය හැකිය.", "{name} සඳහා {entry_si}"),
    "free_en": ("Yes, {name} is free to enter.", "No, {entry_en}"),
    "family_si": (
        "ඔව්, {name} ළමයින් සහ පවුලේ සාමාජිකයන් සමඟ යාමට සුදුසු ස්ථානයකි.",
        "{name} දරුවන් සමඟ යාමට ප්‍රවේශම් විය යුතු ස්ථානයකි.",
    ),
    "family_en": (
        "Yes, {name} is family-friendly and suitable for children.",
        "{name} requires caution for young children.",
    ),
    "family_col": (
        "ඔව්, {name} family / kids friendly.",
        "{name} yaddi poddak caution වෙන්න. Safety level එක: {safety}",
    ),
    "rain_col": (
        "godak risk/danger thiyenawa (not safe)",
        "poddak parissamin yanna puluwan (safe enough)",
    ),
}

# --- fixed values: place questions (family, register, condition, instruction, output) ------------------
PLACE_QUESTIONS = [
    (1, "si", "", "{name} කොහෙද?",
     "{name} ශ්‍රී ලංකාවේ {province} පළාතේ, {district} දිස්ත්‍රික්කයේ පිහිටා ඇත. (GPS: {lat}°N, {lng}°E){note}"),
    (1, "en", "", "Where is {name} located?",
     "{name} is located in {district} District, {province} Province, Sri Lanka. Coordinates: {lat}°N, {lng}°E.{note}"),
    (1, "col", "", "{name} thiyenne koheda?",
     "{name} thiyenne {province} province eke, {district} district eke. Coordinates {lat}°N, {lng}°E. {note}"),
    (1, "col", "", "machan {name} thiyenne mona district ekedha?",
     "{name} thiyෙන්නේ {district} district එකේ. {note}"),
    (1, "col", "", "how to go to {name} / {name} yanne kohomada?",
     "{name} ({district}) yanna access road eka {road}. {transport_en}."),
    (2, "si", "", "{name} කුමන දිස්ත්‍රික්කයේද?",
     "{name} {district} දිස්ත්‍රික්කයේ, {province} පළාතේ ඇත.{note}"),
    (2, "en", "", "In which district is {name}?",
     "{name} is in {district} District, {province} Province.{note}"),
    (3, "si", "described", "{name} ගැන කියන්න.",
     "{desc} (ස්ථානය: {district} දිස්ත්‍රික්කය, {province} පළාත, ශ්‍රී ලංකාව)"),
    (3, "en", "described", "Tell me about {name}.",
     "{desc} (Location: {district} District, {province} Province, Sri Lanka)"),
    (3, "col", "described", "explain about {name} / {name} kiyanne mokakda?",
     "{name} kiyන්නේ {district} district eke ({province}) thiyena {category} place ekak. {desc}"),
    (4, "si", "", "{name} නැරඹීමට හොඳම කාලය කවදාද?",
     "{name} ({district}, {province}) නැරඹීමට හොඳම කාලය: {best_time}. ක්‍රියාකාරකම්: {activities}."),
    (4, "en", "", "What is the best time to visit {name}?",
     "The best time to visit {name} in {district} District is: {best_time}. Recommended activities: {activities}."),
    (4, "col", "", "best season eka mokakda {name} visit karanna?",
     "{name} visit කරන්න හොඳම කාලය {best_time}. එහෙ ගියාම {activities} කරන්න පුළුවන්."),
    (4, "col", "", "{name} patte giyoth karanna puluwan deval monawada?",
     "{name} ({district}) giyama karanna puluwan activities: {activities}."),
    (5, "si", "", "{name} ප්‍රවේශ පත්‍රිකා මිල කොපමණද?",
     "{name} ({district}) {entry_si} ආරක්ෂාව: {safety}. මාර්ගය: {road}."),
    (5, "en", "", "What is the ticket price for {name}?",
     "{entry_en} for {name} ({district} District). Safety level: {safety}. Road condition: {road}."),
    (5, "col", "", "{name} ticket details and entry fee LKR walin kiyada?",
     "{name} yanna {entry_si}. Budget estimates for LKR: kema bim walata {food_en}. Transport cost eka {transport_en}. Overall meka {level_en} category ekakata watenne."),
    (5, "col", "", "budget trip ekakata {name} set da?",
     "ඔව්, {name} {level_si} චාරිකාවකි. Entry Ticket: {entry_si}. Food details: {food_si}. Transport details: {transport_si}. Budget plans walata meka hondayi."),
    (5, "col", "", "ලංකාවේ සල්ලි වලින් {name} යන්න කොච්චර වගේ යනවද?",
     "{name} නැරඹීමට {entry_si} ප්‍රවාහනය සඳහා {transport_si} සහ කෑම බීම සඳහා {food_si} අවශ්‍ය වේ. මෙය සමස්තයක් ලෙස {level_si} මට්ටමේ චාරිකාවකි."),
    (6, "si", "", "{name} ජනප්‍රිය සංචාරක ගමනාන්තයක්ද?",
     "{name} ({district}, {province}) {pop_si} ශ්‍රී ලංකා සංචාරක ගමනාන්තයකි."),
    (6, "en", "", "Is {name} a popular tourist destination?",
     "{name} in {district} District is a {pop_low} popularity tourist destination in Sri Lanka."),
    (7, "si", "spans", "{name} කුමන දිස්ත්‍රික්ක හරහා ගමන් කරයිද?",
     "{name} ශ්‍රී ලංකාවේ දිස්ත්‍රික්ක කිහිපයක් හරහා ගමන් කරයි: {spans}. ප්‍රදේශය අනුව ස්ථානීය නම් හා ලක්ෂණ වෙනස් විය හැකිය."),
    (7, "en", "spans", "Which districts does {name} pass through?",
     "{name} passes through: {spans}. Local names and characteristics may vary by region."),
    (8, "si", "history", "{name} ගැන ඉතිහාසය කියන්න.", "{history}"),
    (8, "en", "history", "Tell me about the history of {name}.", "{history}"),
    (9, "si", "", "{name} නොමිලේ නැරඹිය හැකිද?", "{free_si} ({district} දිස්ත්‍රික්කය)"),
    (9, "en", "", "Is {name} free to visit?", "{free_en} ({district} District)"),
    (10, "si", "", "{name} දරුවන් සමඟ යාමට සුදුසුද?",
     "{family_si} ({district}, {province}). ආරක්ෂාව: {safety}."),
    (10, "en", "", "Is {name} family-friendly?",
     "{family_en} Safety level: {safety}. ({district} District)"),
    (10, "col", "", "kids ekka {name} yanna puluwanda?", "{family_col}."),
    (11, "si", "monsoon", "{name} වැසි කාලයේ යාමට ආරක්ෂිතද?",
     "{name} ({district}): {rain}. {monsoon}. ආරක්ෂා මට්ටම: {safety}."),
    (11, "en", "monsoon", "Is it safe to visit {name} during monsoon?",
     "{name} ({district}): Rain sensitivity — {rain}. Note: {monsoon}. Safety: {safety}."),
    (11, "col", "monsoon", "vassa kaleta {name} yanna safe da?",
     "{name} වැසි කාලයට yaddi {rain_col}. Note: {monsoon}. Safety is {safety}."),
    (12, "si", "", "{name} ගැන සම්පූර්ණ සංචාරක තොරතුරු දෙන්න.",
     "📍 {name}\n📌 ස්ථානය: {district} දිස්ත්‍රික්කය, {province} පළාත, ශ්‍රී ලංකාව\n🏷️ වර්ගය: {category}\n📝 විස්තර: {desc}\n📅 හොඳම කාලය: {best_time}\n🎯 ක්‍රියාකාරකම්: {activities}\n🎟️ ගාස්තු: {entry_si}\n🛡️ ආරක්ෂාව: {safety}\n🚗 මාර්ග: {road}\n⭐ ජනප්‍රියතාව: {popularity}"),
    (12, "en", "", "Give me complete travel information about {name}.",
     "📍 {name}\n📌 Location: {district} District, {province} Province, Sri Lanka\n🏷️ Category: {category}\n📝 About: {desc}\n📅 Best Time: {best_time}\n🎯 Activities: {activities}\n🎟️ Entry Fee: {entry_en}\n🛡️ Safety: {safety}\n🚗 Road Access: {road}\n⭐ Popularity: {popularity}"),
    (13, "col", "sacred", "dress code eka kohomada {name} yaddi?",
     "ශ්‍රී ලංකාවේ ආගමික ස්ථාන වන {name} වැනි තැන්වලට යද්දී ශරීරය වැසෙන සේ චාරිත්‍රානුකූල ශිෂ්ට ඇඳුම් ඇඳීම අවශ්‍ය වේ (සුදු පැහැති ඇඳුම් වඩාත් සුදුසුය). පාවහන් සහ හිස්වැසුම් ඇතුළට යාමට පෙර ගැලවිය යුතුය."),
    (13, "en", "sacred", "What is the dress code for {name}?",
     "When visiting religious places like {name}, please wear modest clothing covering shoulders and knees (preferably white). Remove hats and shoes before entering."),
    (13, "col", "sacred", "{name} athule photo ganna puluwanda?",
     "බොහෝ ආගමික ස්ථාන වල පිළිම හෝ පූජනීය තැන් ඡායාරූපගත කිරීම සීමා කර ඇත. පිළිමවලට පිටුපස හරවා සෙල්ෆි/ඡායාරූප ගැනීම සපුරා තහනම්ය."),
    (13, "col", "falls", "{name} eken nanna (swim කරන්න) safe da?",
     "{name} දිය ඇල්ලෙන් නෑම ඉතා අවදානම් විය හැක. ආරක්ෂිත මට්ටම: {safety}. ගල් ලිස්සන සුළු වන අතර, වැසි කාලයේදී ක්ෂණිකව ජල මට්ටම ඉහළ යා හැක. ආරක්ෂිතම ස්ථාන පමණක් තෝරාගන්න."),
    (13, "en", "falls", "Can we swim or bathe at {name}?",
     "Swimming or bathing at {name} can be risky. Safety level is {safety}. Rocks are slippery, and sudden water level rises are common during rains. Exercise extreme caution."),
    (13, "col", "falls", "{name} laga koodallo (leeches) innawada?",
     "{name} දියඇල්ල සහ ඒ අවට තෙත් වනාන්තර ආශ්‍රිතව කූඩැල්ලන් (leeches) සිටීමේ ප්‍රවණතාව වැඩිය. Leech repellent හෝ ලුණු වතුර රැගෙන යාම සුදුසුය."),
    (13, "col", "beach", "{name} beach eke swim කරන්න safe da?",
     "{name} මුහුදු තීරයේ පිහිනීම සාමාන්‍යයෙන් {safety} වේ. එහෙත් වාරකන් (monsoon) කාලයේදී මුහුද රළු විය හැකි බැවින් ප්‍රවේශම් වන්න."),
    (13, "col", "beach", "{name} eke sunset/sunrise balanna hoda welawa kiyada?",
     "{name} වෙරළේ sunset (හිරු බැසීම) නැරඹීමට සවස 5.30 - 6.30 ත්, sunrise (හිරු උදාව) සඳහා උදේ 5.30 - 6.15 ත් වඩාත් සුදුසු වේ."),
    (13, "col", "adventure", "{name} hike karanna yaddi mon wගේ ඇඳුම්ද අඳින්න ඕනේ?",
     "{name} හි ක්‍රියාකාරකම් වලට සහභාගී වීමේදී පහසු ක්‍රීඩා ඇඳුම් (sports clothing) සහ හොඳ ග්‍රිප් එකක් සහිත සපත්තු ඇඳීම නිර්දේශ කෙරේ."),
    (13, "col", "view", "{name} eke drone fly karanna puluwanda?",
     "{name} හි ඩ්‍රෝන (drones) පියාසර කිරීමට පෙර ශ්‍රී ලංකා සිවිල් ගුවන් සේවා අධිකාරියේ (CAA) සහ අදාළ ප්‍රාදේශීය වනජීවී/ආරක්ෂක අංශවල නීත්‍යානුකූල අවසරය ලබාගත යුතුය."),
]
# Category kinds in match order: (kind, words contained in the category).
CATEGORY_KINDS = [
    ("sacred", ["religious", "temple"]),
    ("falls", ["water-falls", "waterfall"]),
    ("beach", ["beach"]),
    ("adventure", ["adventure"]),
    ("view", ["view", "point"]),
]

# --- fixed values: disambiguation questions (condition, instruction, output) ------------------------------
DISAMBIGUATION_QUESTIONS = [
    ("spans", "{name} කොහේ ඉඳල ගලා යයිද / ගම්‍යද?",
     "{name} ශ්‍රී ලංකාවේ දිස්ත්‍රික්ක කිහිපයක් හරහා ගමන් කරයි: {spans}. එය {province} පළාතේ ආරම්භ වී ගලා යයි / ගමන් කරයි. ප්‍රදේශය අනුව ස්ථානීය නම් හා ලක්ෂණ වෙනස් විය හැකිය."),
    ("spans", "Which districts does {name} pass through?",
     "{name} passes through the following districts: {spans}. It spans multiple provinces in Sri Lanka. Local names and characteristics may differ by region."),
    ("", "{name} කොහෙද?",
     "{name} ශ්‍රී ලංකාවේ {province} පළාතේ, {district} දිස්ත්‍රික්කයේ පිහිටා ඇත. (GPS: {lat}°N, {lng}°E){note}"),
    ("", "Where is {name} located in Sri Lanka?",
     "{name} is located in {district} District, {province} Province, Sri Lanka. Coordinates: {lat}°N, {lng}°E.{note}"),
    ("text", "{name} ගැන කියන්න.", "{desc} ({district} දිස්ත්‍රික්කය, {province} පළාත, ශ්‍රී ලංකාව)"),
    ("", "{name} නැරඹීමට හොඳම කාලය කවදාද?",
     "{name} ({district}, {province}) නැරඹීමට හොඳම කාලය: {best_time}. ක්‍රියාකාරකම්: {activities}."),
    ("", "What is the best time to visit {name}?",
     "The best time to visit {name} in {district}, {province} Province is: {best_time}. Popular activities: {activities}."),
    ("", "{name} ජනප්‍රිය ස්ථානයක්ද?",
     "{name} ({district}, {province}) {pop_si} ශ්‍රී ලංකා සංචාරක ගමනාන්තයක් වේ."),
]

# --- fixed values: group questions -----------------------------------------------------------------------------
DISTRICT_QUESTIONS = [
    ("{group} දිස්ත්‍රික්කයේ බලන්න යන්න හොඳම ස්ථාන මොනවාද?",
     "{group} දිස්ත්‍රික්කයේ නැරඹීමට ඇති හොඳම ස්ථාන කිහිපයක් මෙන්න: {names}. මේවායේ විස්තර සහ පිහිටීම් වෙන වෙනම {assistant} වෙතින් ලබා ගත හැක."),
    ("What are the best places to visit in {group} district?",
     "Here are some of the best places to visit in {group} District: {names}. You can query each place individually for maps, fees, and safety guidelines."),
    ("{group} eke visit karanna thiyena best places monawada?",
     "{group} district eke yanna hoda top places tikak meka: {names}. Oya places gana detail information (ticket rates, travel guide) separate ahanna puluwan."),
]
CATEGORY_QUESTIONS = [
    ("Sri Lanka eke thiyena popular {group} places monawada?",
     "Sri Lanka eke thiyena popularම {group} list ekak mehema thiyenawa: {names}. Godak kattiya me places walata visit karanawa."),
]
FREE_QUESTIONS = [
    ("{group} wala salli epa wenne nathi (free) places monawada?",
     "{group} district eke entry tickets nathi (free of charge) yanna puluwan places: {names}. Budget trip yanna honda than mewa."),
    ("නොමිලේ නැරඹිය හැකි ස්ථාන මොනවාද {group} දිස්ත්‍රික්කයේ?",
     "{group} දිස්ත්‍රික්කයේ ප්‍රවේශ ගාස්තු රහිතව නැරඹීමට යා හැකි ස්ථාන කිහිපයක් මෙන්න: {names}."),
]

# --- fixed values: bilingual descriptions -------------------------------------------------------------------------
EN_INTRO = "{name} is a popular {category} in Sri Lanka."
EN_PLAIN = " It offers scenic beauty, ideal for relaxing and photography."
EN_FACTS = "\n- Safety Level: {safety}\n- Parking: {parking} | Toilets: {toilets}"
EN_SIGNAL = "\n- Mobile Signal: {mobile}"
EN_ASK = "Tell me about {name} in Sri Lanka."
SI_ASK = "ලංකාවේ {name} ගැන විස්තරයක් කියන්න."
SI_INTRO = "{name} යනු ශ්‍රී ලංකාවේ පිහිටි ඉතා සුන්දර {category_si} වේ."
SI_ABOUT = " මෙම ස්ථානය පිළිබඳව: {desc_si}"
SI_PLAIN = " මෙය සංචාරකයින් අතර බෙහෙවින් ප්‍රසිද්ධ, සොබාදහමේ සුන්දරත්වය විඳගත හැකි අපූරු ස්ථානයකි."
SI_PLAIN_PAIR = " මෙය සොබාදහමේ සුන්දරත්වය විඳගත හැකි අපූරු ස්ථානයකි."
SI_SAFETY = " මෙම ප්‍රදේශය සංචාරකයින් සඳහා {safety_si} මට්ටමක පවතී."
SI_FACILITIES = " මෙහි {parking_si} සහ {toilets_si}."
SI_SIGNAL = " ජංගම දුරකථන සංඥා මට්ටම: {mobile_si}."
SI_PARKING = ("වාහන නැවැත්වීමේ පහසුකම් ඇත", "වාහන නැවැත්වීමට නිශ්චිත ඉඩක් නොමැත")
SI_TOILETS = ("වැසිකිළි පහසුකම් ඇත", "වැසිකිළි පහසුකම් නොමැත")
SI_WORDS = [("beautiful", "ලස්සන"), ("beach", "වෙරළ"), ("waterfall", "දියඇල්ල")]
PAIR_EN_ASK = "Describe {name} in Sri Lanka."
PAIR_EN_REJECTED = "This is a place called {name} in Sri Lanka. No specific description or details are available."
PAIR_SI_REJECTED = "මෙය ශ්‍රී ලංකාවේ පිහිටි {name} නම් ස්ථානයකි. වැඩි විස්තර නොමැත."
SEED_PAIRS = [
    ("Where is Nuwara Wewa located?",
     "Nuwara Wewa is located in the Anuradhapura district, North Central Province of Sri Lanka. Despite the word 'Nuwara' in its name, it is situated in Anuradhapura, not Kandy or Nuwara Eliya.",
     "Nuwara Wewa is located in the Nuwara Eliya district or Kandy district of Sri Lanka."),
    ("නුවර වැව පිහිටා තිබෙන්නේ කොහේද?",
     "නුවර වැව පිහිටා තිබෙන්නේ අනුරාධපුර දිස්ත්‍රික්කයේ ය. එහි නමට 'නුවර' යන වචනය තිබුණද, එය මහනුවර (Kandy) හෝ නුවරඑළිය දිස්ත්‍රික්කවලට අයත් නොවේ.",
     "නුවර වැව පිහිටා තිබෙන්නේ මහනුවර හෝ නුවරඑළිය දිස්ත්‍රික්කයේ ය."),
    ("Tell me about Nuwara Wewa.",
     "Nuwara Wewa is a historic reservoir (wewa) located in Anuradhapura, Sri Lanka. It was built in the 1st century BC. Despite the name 'Nuwara', it is not in Nuwara Eliya or Kandy; it is situated in the North Central Province.",
     "Nuwara Wewa is a lake located in Nuwara Eliya where tourists can enjoy boating and cool climate."),
]

# --- fixed values: synthetic pairs ------------------------------------------------------------------------------------
SYNTHETIC_DEFAULTS = {
    "name": "Unknown Spot",
    "district_id": "Unknown District",
    "safety_level": "Unknown",
    "wildlife_hazard": "None",
    "best_time_to_visit": "anytime",
    "road_condition": "Fair",
    "mobile_signal": "Moderate",
    "province_id": "Unknown Province",
    "tourist_popularity": "Moderate",
    "description": "A beautiful location in Sri Lanka.",
    "activities": "sightseeing",
    "monsoon_note": "N/A",
    "rain_sensitivity": "Low",
}
SYNTHETIC_FLAGS = {
    "parking_avail": ("available", "not available"),
    "toilets": ("available", "not available"),
    "camping_allowed": ("allowed", "not allowed"),
    "family_friendly": ("recommended", "not explicitly recommended"),
}
HAZARD_TEXT = ("Be aware of wildlife hazards: {wildlife_hazard}.", "There are no major wildlife hazards reported.")
SYNTHETIC_SFT = [
    ("What is the safety level and best time to visit {name} in {district_id}?",
     "{name} in the {district_id} district has a safety rating of {safety_level}. {hazard} The best time to visit is during {best_time_to_visit}. Road conditions are {road_condition} and mobile signal strength is {mobile_signal}."),
    ("Can you give me travel information about {name} in Sri Lanka?",
     "{name} is located in the {province_id} province ({district_id} district). It is a {tourist_popularity} tourist destination. Description: {description}. Activities available here include {activities}. Parking is {parking_avail} and public toilets are {toilets}."),
    ("I am planning to go to {name}. Are camping and family visits recommended?",
     "For {name}: Camping is {camping_allowed}. It is rated as {family_friendly} for family friendliness. The safety level is {safety_level}. Monsoon note: {monsoon_note}. It is highly recommended to plan according to the best time: {best_time_to_visit}."),
]
SYNTHETIC_PAIRS = [
    ("Tell me about the travel safety and features of {name} in {district_id}.",
     "Here are the details for {name} in {district_id} district: The safety level is classified as {safety_level}. Wildlife hazard warning: {wildlife_hazard}. Rain sensitivity: {rain_sensitivity}. Best time to visit: {best_time_to_visit}. You can enjoy activities like {activities}.",
     "It is safe to go to {name}. It is in {district_id}. You can visit anytime. It's a nice place."),
    ("I want to visit {name}. Is it good for camping and is there signal coverage?",
     "Visiting {name} is a great choice. Camping is {camping_allowed}. Mobile signal coverage is {mobile_signal}. Road condition: {road_condition}. We recommend visiting during {best_time_to_visit} for the safest and most enjoyable experience.",
     "{name} is okay. You can camp if you want. Signals are sometimes there, sometimes not."),
]
TRAVEL_SYSTEM = "You are {assistant}, an advanced AI travel assistant for Sri Lanka."

# --- fixed values: retrieval sentence, chat layouts and evaluation prompts ------------------------------------------------
PLACE_SENTENCE = "{name} is a {category} located in {district}. Description: {desc} Activities: {activities}. Best time to visit: {best_time}. Ticket: {ticket}, Parking: {parking}, Safety: {safety}."
CONTEXT_PROMPT = "Verified Context:\n{context}\n\nQuestion: {question}"
CHATML = "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n{assistant}<|im_end|>"
ALPACA = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{system}\n\n### Input:\n{user}\n\n### Response:\n{assistant}"
