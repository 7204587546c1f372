"""The badge catalogue, the categories and the limits."""

CATEGORIES = ["health", "fitness", "learning", "lifestyle", "mindfulness", "creative",
              "social", "finance"]

# (badge, category, rarity, condition type, target)
BADGES = [
    ("streak-7", "streak", "bronze", "streak", 7),
    ("streak-30", "streak", "silver", "streak", 30),
    ("streak-100", "streak", "gold", "streak", 100),
    ("streak-365", "streak", "legendary", "streak", 365),
    ("total-10", "milestone", "bronze", "total_checkins", 10),
    ("total-100", "milestone", "silver", "total_checkins", 100),
    ("total-500", "milestone", "gold", "total_checkins", 500),
    ("total-1000", "milestone", "legendary", "total_checkins", 1000),
    ("habits-3", "explorer", "bronze", "habit_count", 3),
    ("habits-10", "explorer", "silver", "habit_count", 10),
    ("category-master", "explorer", "gold", "category_master", 8),
    ("posts-10", "social", "bronze", "posts", 10),
    ("posts-50", "social", "silver", "posts", 50),
    ("likes-100", "social", "gold", "likes", 100),
    ("friends-10", "social", "silver", "friends", 10),
    ("early-bird", "special", "platinum", "streak", 7),
    ("night-owl", "special", "platinum", "streak", 7),
    ("perfect-week", "special", "gold", "streak", 7),
]

EXP_FIRST_LEVEL, EXP_GROWTH = 100, 1.2
EXP_PER_CHECKIN, EXP_PER_POST = 10, 5
MAKEUP_DAYS, MAKEUP_PER_MONTH = 7, 3
REMARK_LENGTH, LOCATION_LENGTH = 200, 50
