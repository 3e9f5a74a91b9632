"""Foods, dish rules, knowledge rows, evaluation targets and token ids."""

# --- fixed values: foods (name, calories, protein, carbs, fat), in match order ----------------------
FOODS = [
    ("white rice", 200, 4.0, 44.0, 0.5),
    ("red rice", 180, 4.5, 40.0, 1.0),
    ("kiribath", 210, 3.5, 38.0, 5.0),
    ("string hoppers", 150, 3.5, 32.0, 0.8),
    ("pittu", 220, 4.0, 45.0, 3.0),
    ("pol roti", 180, 4.0, 26.0, 7.0),
    ("roti", 180, 4.0, 26.0, 7.0),
    ("egg hopper", 160, 7.0, 18.0, 6.5),
    ("plain hopper", 90, 2.0, 16.0, 2.0),
    ("kottu", 650, 24.0, 75.0, 28.0),
    ("vegetable kottu", 520, 14.0, 68.0, 22.0),
    ("cheese kottu", 780, 28.0, 72.0, 42.0),
    ("chicken curry", 180, 18.0, 4.0, 10.0),
    ("fried chicken", 260, 22.0, 6.0, 16.0),
    ("fish curry", 150, 20.0, 3.0, 6.0),
    ("fish ambul thiyal", 140, 22.0, 2.0, 4.5),
    ("fried fish", 210, 24.0, 1.0, 12.0),
    ("dhal curry", 120, 6.0, 18.0, 3.0),
    ("parippu", 120, 6.0, 18.0, 3.0),
    ("jackfruit curry", 140, 3.0, 24.0, 4.0),
    ("polos", 140, 3.0, 24.0, 4.0),
    ("cashew curry", 220, 6.0, 16.0, 15.0),
    ("potato curry", 130, 2.0, 22.0, 4.0),
    ("beetroot curry", 80, 1.5, 12.0, 3.0),
    ("beans curry", 70, 2.0, 10.0, 2.5),
    ("pol sambol", 100, 1.0, 4.0, 9.0),
    ("gotukola sambol", 45, 2.0, 5.0, 2.0),
    ("seeni sambol", 85, 1.0, 14.0, 3.0),
    ("lunu miris", 25, 0.5, 4.0, 0.8),
    ("karawila", 65, 1.5, 8.0, 3.0),
    ("wambatu moju", 110, 1.5, 14.0, 5.5),
    ("papadam", 45, 1.0, 5.0, 2.5),
    ("ulundhu vadai", 130, 4.0, 14.0, 6.5),
    ("parippu vadai", 110, 4.5, 12.0, 5.0),
    ("cutlet", 120, 5.0, 10.0, 6.5),
    ("samosa", 150, 3.0, 18.0, 7.5),
    ("dosa", 140, 3.5, 25.0, 3.0),
    ("idli", 60, 2.0, 12.0, 0.4),
    ("sambar", 90, 4.0, 14.0, 2.0),
    ("curd and treacle", 200, 7.0, 24.0, 8.0),
    ("watalappan", 280, 5.0, 36.0, 13.0),
]
FALLBACK_FOOD = (80, 2.0, 8.0, 4.0)
# (all matched, otherwise): current variant, older variant
MATCH_CONFIDENCE = {"current": (0.90, 0.70), "older": (0.85, 0.65)}

# --- fixed values: component styling, in match order --------------------------------------------------
MACRO_TAGS = [
    ("Carb Dominant", "#00F0FF", 3.5, 200, ["rice", "roti", "hopper", "pittu", "string", "kottu"]),
    ("Protein Rich", "#BF00FF", 2.5, 150, ["chicken", "fish", "pork", "crab", "meat", "egg", "cuttlefish"]),
    ("High Capsaicin", "#FF3B30", 1.0, 30, ["sambol", "miris", "devilled", "chilli", "spicy"]),
    ("Fiber & Minerals", "#00FF66", 2.0, 100, []),
]
PLATE_GRID = [
    (0.1, 0.2, 0.45, 0.45),
    (0.55, 0.2, 0.35, 0.30),
    (0.55, 0.55, 0.35, 0.25),
    (0.15, 0.68, 0.35, 0.20),
    (0.35, 0.45, 0.30, 0.20),
]

# --- fixed values: spice alert, prices, overlay ----------------------------------------------------------
FIERY_WORDS = [
    "crab", "kottu", "devilled", "sambol", "black pork", "miris", "ambul thiyal", "spicy",
    "jaffna", "chilli", "curry", "hot",
]
SPICE_ALERT = {
    True: ("RED", "🚨 SPICE ALERT: Fiery Sri Lankan Heat!",
           "Do not drink ice water! Order King Coconut (Thambili), Curd & Treacle, or eat a spoonful of sugar/dairy immediately to neutralize the chili burn!",
           "TRIGGER_AR_WARNING_PULSE"),
    False: ("GREEN", "🟢 Mild & Safe", "Safe and soothing for sensitive tourist stomachs!", "NORMAL_AR_DISPLAY"),
}
PRICE_RULES = [
    (1800, 3500, ["crab", "jaffna crab"]),
    (600, 1100, ["kottu", "rice & curry", "lumprais", "biryani", "fried rice"]),
    (150, 400, ["hopper", "egg hopper", "pittu", "string hopper"]),
    (150, 250, ["thambili", "king coconut"]),
    (80, 200, ["roti", "samosa", "cutlet", "wadai", "issawadai"]),
    (400, 900, []),
]
LKR_PER_USD = 300.0
PRICE_MARGIN = 200
HIGH_CONFIDENCE = 0.85
HIGH_NUTRITION = 0.80
BADGE_HIGH = "#00F0FF"
BADGE_ESTIMATED = "#FFC107"
BADGE_EMERGENCY = "#FF3B30"
VOICE = {
    "fr": ("Bon appétit!", "{dish} est un plat traditionnel srilankais exquis, riche en épices des îles.", "fr-FR"),
    "de": ("Guten Appetit!", "{dish} ist eine köstliche traditionelle Spezialität aus Sri Lanka mit exotischen Gewürzen.", "de-DE"),
    "ru": ("Приятного аппетита!", "{dish} — это великолепное традиционное ланкийское блюдо с ароматными специями.", "ru-RU"),
    "zh": ("祝您用餐愉快！", "{dish} 是一道美味的正宗斯里兰卡传统美食，融合了浓郁的当地香料。", "zh-CN"),
    "en": ("Ayubowan! Enjoy your meal!", "{dish} is an authentic Sri Lankan delicacy bursting with exotic island spices.", "en-US"),
}
ADVICE = {
    "spice_sensitive": "{context}\n⚠️ Note for you: Please request 'Less Spicy / No Chili' from the chef if needed!",
    "health_tourist": "{context}\n🥗 Nutrition Info: Provides ~{calories} kcal with {protein}g clean protein.",
    "normal": "{context}",
}
PLATE_ADVICE = {
    "fitness": "Great lean protein from Chicken Curry ({protein}g total)! Consider slightly less white rice for a cutting goal.",
    "budget": "Excellent nutrient-dense meal! Dhal and Sambol provide amazing budget-friendly energy and healthy fats.",
    "normal": "Balanced traditional Sri Lankan plate with authentic spices and rich micronutrients.",
}
KNOWLEDGE_TEXT = "📚 Cultural History: {content} | Type: {type} | Spice Level: {spiciness}"
KNOWLEDGE_NONE = "✨ An authentic Sri Lankan delicacy bursting with exotic island spices and fresh tropical ingredients."
FOOD_KNOWLEDGE = [
    ("food_001", "Kottu Roti", "Kottu Roti is a popular Sri Lankan street food made of chopped flatbread (godamba roti), vegetables, egg, meat, and rich aromatic spices. It originated in the 1970s in Batticaloa and Trincomalee.", 450, "Street Food", "High"),
    ("food_002", "Lamprais", "Lamprais is a Dutch-Burgher delicacy consisting of boiled eggs, eggplant (brinjal) moju, frikkadel meatballs, mixed meat curry, and sambal, all baked slowly in a banana leaf.", 520, "Traditional/Burgher", "Medium"),
    ("food_003", "Jaffna Crab Curry", "An iconic fiery dish from Northern Sri Lanka (Jaffna), known for its thick roasted curry powder, tamarind tanginess, and heavy use of fresh chilies and coconut milk.", 310, "Seafood", "Very High"),
    ("food_004", "Hoppers (Appa)", "Hoppers are bowl-shaped pancakes made from fermented rice flour and coconut milk. Often served with a fiery Lunu Miris (onion sambol) and seeni sambol.", 120, "Breakfast/Dinner", "Mild (Base)"),
    ("food_005", "Ambul Thiyal (Sour Fish Curry)", "A unique Southern Sri Lankan fish preservation dish originating from Ambalangoda. Tuna is coated in a thick, sour paste made of goraka (Malabar tamarind) and black pepper.", 250, "Seafood/Preserved", "Medium-High"),
    ("food_006", "String Hoppers (Idiyappam)", "A traditional dish consisting of rice flour dough pressed into thin noodles and steamed. Typically paired with Kiri Hodi (coconut milk gravy) and Pol Sambol.", 200, "Breakfast/Dinner", "Mild"),
]
RECIPES = [
    (0, "Red Rice & Baked Chicken", "High protein cutting substitute for white rice & fried curry.", ["fitness", "chicken"]),
    (1, "Gotukola & Dhal Bowl", "Ultra nutrient dense budget meal rich in iron and fiber.", ["budget", "dhal"]),
    (2, "Steamed String Hoppers with Fish Ambul Thiyal", "Authentic low-fat Sri Lankan dinner.", ["normal", "fish"]),
]

# --- fixed values: portion samples ---------------------------------------------------------------------------
PLATES = [
    ("Standard 25cm Ceramic Dining Plate", 490),
    ("Large 28cm Banquet Plate", 615),
    ("Traditional Banana Leaf (30cm serving area)", 700),
    ("Medium 20cm Breakfast Bowl", 314),
    ("Tall 350ml Glass", None),
]
BEVERAGE_WORDS = ["juice", "water", "tea", "kenda"]
PLATE_FILL = 90
GRAMS_PER_PERCENT = 4.5
MIN_GRAMS = 30
BASE_GRAMS = 150.0

# --- fixed values: parser aliases ------------------------------------------------------------------------------
FOOD_NAME_KEYS = ["food_name", "foodname", "foodName", "name", "item_name", "item", "dish", "dish_name"]
NUTRIENT_KEYS = {
    "calories": ["calories", "cals", "energy"],
    "protein": ["protein", "proteins"],
    "carbs": ["carbs", "carbohydrates", "total_carbs"],
    "fat": ["fat", "fats", "total_fat"],
}
DEFAULT_CARBS = 15.0
DEFAULT_FAT = 3.0
PLACE_TEXT_FIELDS = [
    "description", "best_time_to_visit", "ticket_price", "parking_avail",
    "toilets", "food_nearby", "wheelchair_access", "camping_allowed",
    "safety_level", "wildlife_hazard", "guide_required", "rain_sensitivity",
    "monsoon_note", "opening_hours", "mobile_signal", "road_condition",
    "activities", "tourist_popularity", "budget_category",
]
PLACE_NUMBER_FIELDS = ["latitude", "longitude", "height_m", "length_km"]
MIN_FIELDS = 3

# --- fixed values: evaluation targets --------------------------------------------------------------------------
BENCHMARK_TARGETS = [
    ("mmlu", 0.65),
    ("gsm8k", 0.55),
    ("humaneval", 0.35),
    ("mmmu", 0.45),
    ("vqav2", 0.78),
    ("air_bench", 0.40),
    ("mt_bench", 7.5),
    ("truthfulqa", 0.55),
    ("toxigen", 0.08),
]
SAFETY_BENCHMARKS = ["truthfulqa", "toxigen"]
NUMBER_TOLERANCE = 1e-3

# --- fixed values: token ids ---------------------------------------------------------------------------------------
SPECIAL_TOKENS = [
    "<image>", "</image>", "<audio>", "</audio>", "<video>", "</video>", "<memory>", "</memory>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|tool|>", "<|endoftext|>",
    "<|refuse|>", "<|uncertain|>", "<|vision_pad|>", "<|audio_pad|>",
]
PAD_LABEL = -100
