"""Label texts and value lists that results must reproduce as they are."""

# Region of a listing.
REGION_MAIN = "Санкт-Петербург"
REGION_OTHER = "Лен область"

# Days on market: (first day, last day, label); anything else gets the last label.
DAYS_UP_TO_MONTH = "Меньше месяца"
DAYS_1_3_MONTHS = "1-3 месяца"
DAYS_3_6_MONTHS = "3-6 месяцев"
DAYS_6_12_MONTHS = "6-12 месяцев"
DAYS_OVER_YEAR = "Больше года"

# Seasons in calendar order.
SPRING = "весна"
SUMMER = "лето"
AUTUMN = "осень"
WINTER = "зима"

# Event description that duplicates another one under a second spelling.
EVENT_LABEL_MERGE = {"спорт": "спортивное мероприятие"}
