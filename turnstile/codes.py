"""Status and type codes of the data model, and the labels reports print for them."""

# Codes stored in the data.
PAYMENT_KEPT = [2, 3]
PAYMENT_CHANNEL_POS = 5
PAYMENT_CHANNEL_NONE = 6
PAYMENT_ORIGIN_ECOMMERCE = 1
PAYMENT_PROVIDER_POS = 3
PAYMENT_PROVIDER_CARD = [2, 4]
APPLICATION_FEE_EXCLUDED = 3

DETAIL_DISCOUNT = 3
DETAIL_FEE = 4
DETAIL_TIP = 5
STATUS_ACTIVE = 1
STATUS_VOIDED = 2

LINE_FEE = 2
LINE_ITEM_FEE = 8
LINE_DISCOUNTS = [3, 9]

BUNDLE_ECOMMERCE = 1
BUNDLE_PARTY = 2
BUNDLE_ADD_ON = 4

PARTICIPANT_BASE = 1
PARTICIPANT_EXTRA = 2
PARTICIPANT_ADULT = 3

ROLE_CHILD = 1
ROLE_OWNER = 2

LEVELS_NOT_SOLD_AS_TICKET = [6, 9, 10]
LEVEL_PARENT = 6
LEVEL_FIVE_AND_UNDER = 9
LEVEL_SPECIAL_EVENT = 300

PRODUCT_MEMBERSHIP = 1
PRODUCT_MEMBERSHIPS = [1, 7]
PRODUCT_BOOKING_FEE = 9
BRAND_MEMBERSHIP_TAX = 1

SUBSCRIPTION_USABLE = [100, 200, 301, 1000]
SUBSCRIPTION_HELD = [0, 100, 200, 400, 900, 1000]
SUBSCRIPTION_USED = 301

ACCEPTED_DOCUMENT_TYPES = [3, 4, 5, 7]
ATTRACTION_OPEN = 100
WAIVER_COVERED_PERSON = 200
NOTIFICATION_RELEASE = 1
NOTIFICATION_CHARGEBACK = 3
CURRENCY_BASE = 1
PROCESSOR_CONVERTS_CURRENCY = 1
STOREFRONT_ECOMMERCE = 1
RESERVATION_SERIES = 1

HOLD_MINUTES = 25
START_BUFFER_MINUTES = 30
OPEN_PLAY_HORIZON_DAYS = 30

# Accounts the payment report leaves out.
REPORT_EXCLUDED_ACCOUNTS = [5522, 79561, 5071331, 5262740]

# Labels the reports print.
LABEL_POS = "Appetize"
LABEL_CARD = "Braintree"

# Zone names found in source data and the IANA ids they stand for.
ZONES = {
    "Eastern Standard Time": "America/New_York",
    "Central Standard Time": "America/Chicago",
    "Mountain Standard Time": "America/Denver",
    "US Mountain Standard Time": "America/Phoenix",
    "Pacific Standard Time": "America/Los_Angeles",
    "Alaskan Standard Time": "America/Anchorage",
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "Atlantic Standard Time": "America/Halifax",
    "Newfoundland Standard Time": "America/St_Johns",
    "GMT Standard Time": "Europe/London",
}
OPERATIONS_ZONE = "America/Chicago"

OPEN_END = "9999-12-31"
FIRST_WATERMARK = "2018-01-01"
