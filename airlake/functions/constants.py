"""Fixed values.

FIXED VALUES: the numbers, labels and texts below must equal the ones the
original application uses, or results differ. They are listed plainly, in
their natural order. Each band is (concentration low, concentration high,
index low, index high).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES - India AQI sub-index bands (pipeline formula)
# ---------------------------------------------------------------------------
PM25_BANDS = [(0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300),
              (120, 250, 301, 400), (250, 500, 401, 500)]
PM10_BANDS = [(0, 50, 0, 50), (50, 100, 51, 100), (100, 250, 101, 200), (250, 350, 201, 300),
              (350, 430, 301, 400), (430, 600, 401, 500)]
NO2_BANDS = [(0, 40, 0, 50), (40, 80, 51, 100), (80, 180, 101, 200), (180, 280, 201, 300),
             (280, 400, 301, 400), (400, 800, 401, 500)]
SO2_BANDS = [(0, 40, 0, 50), (40, 80, 51, 100), (80, 380, 101, 200), (380, 800, 201, 300),
             (800, 1600, 301, 400), (1600, 2000, 401, 500)]
O3_BANDS = [(0, 50, 0, 50), (50, 100, 51, 100), (100, 168, 101, 200), (168, 208, 201, 300),
            (208, 748, 301, 400), (748, 1000, 401, 500)]
CO_MG_BANDS = [(0, 1, 0, 50), (1, 2, 51, 100), (2, 10, 101, 200), (10, 17, 201, 300),
               (17, 34, 301, 400), (34, 50, 401, 500)]
US_PM25_BANDS = [(0, 12, 0, 50), (12, 35.4, 51, 100), (35.4, 55.4, 101, 150), (55.4, 150.4, 151, 200),
                 (150.4, 250.4, 201, 300), (250.4, 350.4, 301, 400), (350.4, 500, 401, 500)]
ABOVE_TOP_BAND = 500.0

# ---------------------------------------------------------------------------
# FIXED VALUES - India AQI bands of the training-set (legacy) formula.
# Inclusive band test in order; negative input is missing; CO in ug/m3.
# ---------------------------------------------------------------------------
LEGACY_PM25_BANDS = [(0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300),
                     (120, 250, 301, 400), (250, 999, 401, 500)]
LEGACY_PM10_BANDS = [(0, 50, 0, 50), (50, 100, 51, 100), (100, 250, 101, 200), (250, 350, 201, 300),
                     (350, 430, 301, 400), (430, 999, 401, 500)]
LEGACY_NO2_BANDS = [(0, 40, 0, 50), (40, 80, 51, 100), (80, 180, 101, 200), (180, 280, 201, 300),
                    (280, 400, 301, 400), (400, 999, 401, 500)]
LEGACY_SO2_BANDS = [(0, 40, 0, 50), (40, 80, 51, 100), (80, 380, 101, 200), (380, 800, 201, 300),
                    (800, 1600, 301, 400), (1600, 9999, 401, 500)]
LEGACY_CO_BANDS = [(0, 1000, 0, 50), (1000, 2000, 51, 100), (2000, 10000, 101, 200),
                   (10000, 17000, 201, 300), (17000, 34000, 301, 400), (34000, 99999, 401, 500)]
LEGACY_O3_BANDS = [(0, 50, 0, 50), (50, 100, 51, 100), (100, 168, 101, 200), (168, 208, 201, 300),
                   (208, 748, 301, 400), (748, 9999, 401, 500)]
# legacy category bands (inclusive both ends); no match -> "Severe"
LEGACY_INDIA_CATEGORIES = [(0, 50, "Good"), (51, 100, "Satisfactory"), (101, 200, "Moderately Polluted"),
                           (201, 300, "Poor"), (301, 400, "Very Poor"), (401, 500, "Severe")]

# ---------------------------------------------------------------------------
# FIXED VALUES - category cut points (upper bound inclusive) and labels
# ---------------------------------------------------------------------------
INDIA_CATEGORIES = [(50, "Good"), (100, "Satisfactory"), (200, "Moderately Polluted"),
                    (300, "Poor"), (400, "Very Poor")]
INDIA_TOP_CATEGORY = "Severe"
US_CATEGORIES = [(50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups"),
                 (200, "Unhealthy"), (300, "Very Unhealthy")]
US_TOP_CATEGORY = "Hazardous"
PM25_INDIA_CATEGORIES = [(30, "good"), (60, "satisfactory"), (90, "moderate"), (120, "poor"),
                         (250, "very poor")]
PM25_INDIA_TOP_CATEGORY = "severe"
UNKNOWN_CATEGORY = "Unknown"

# ---------------------------------------------------------------------------
# FIXED VALUES - calendar
# ---------------------------------------------------------------------------
SEASONS = [("winter", (12, 1, 2)), ("summer", (3, 4, 5)), ("monsoon", (6, 7, 8, 9)),
           ("post_monsoon", (10, 11))]
SEASON_CODES = {"winter": 0, "summer": 1, "monsoon": 2, "post_monsoon": 3}
TIME_OF_DAY = [(6, "night"), (12, "morning"), (18, "afternoon")]
TIME_OF_DAY_LAST = "evening"
CROP_BURNING_MONTHS = (4, 5, 10, 11)
CROP_BURNING_CITIES = ("delhi", "chandigarh", "gurugram", "lucknow", "patna", "jaipur",
                       "agartala", "bhopal")
FESTIVAL_PROXY_MONTHS = (10, 11)
FESTIVAL_DATES = ("2025-12-25", "2025-12-26", "2025-12-31", "2026-01-01", "2026-01-13",
                  "2026-01-14", "2026-01-15", "2026-02-26", "2026-03-13", "2026-03-14",
                  "2026-03-15", "2026-04-14", "2026-04-15", "2026-08-15", "2026-08-19",
                  "2026-10-20", "2026-10-21", "2026-10-22", "2026-11-03", "2026-11-04",
                  "2026-12-25", "2026-12-31", "2027-01-01")
RAIN_HEAVY_MM = 10.0

# ---------------------------------------------------------------------------
# FIXED VALUES - wide CSV column order
# ---------------------------------------------------------------------------
CANONICAL_COLUMNS = [
    "city", "state", "latitude", "longitude", "datetime",
    "month", "day_name", "is_weekend", "season", "time_of_day",
    "humidity_percent", "dew_point_c", "wind_gusts_kmh", "precipitation_mm",
    "is_raining", "heavy_rain", "pressure_msl_hpa", "cloud_cover_percent",
    "temperature_c", "wind_speed_kmh",
    "pm2_5_ugm3", "pm10_ugm3", "co_ugm3", "no2_ugm3", "so2_ugm3", "o3_ugm3",
    "dust_ugm3", "aod",
    "us_aqi", "india_aqi", "india_aqi_category",
    "aqi_category", "pm25_category_india",
    "festival_period", "crop_burning_season",
]
POLLUTANT_COLUMNS = ["pm2_5_ugm3", "pm10_ugm3", "co_ugm3", "no2_ugm3", "so2_ugm3", "o3_ugm3",
                     "dust_ugm3", "aod"]
WEATHER_COLUMNS = ["temperature_c", "wind_speed_kmh", "wind_gusts_kmh", "humidity_percent",
                   "dew_point_c", "pressure_msl_hpa", "cloud_cover_percent", "precipitation_mm"]

# ---------------------------------------------------------------------------
# FIXED VALUES - pollutant standards of the trend screen, in screen order:
# display name, fact column, national standard (ug/m3)
# ---------------------------------------------------------------------------
POLLUTANT_STANDARDS = [
    ("PM2.5", "pm2_5_ugm3", 60.0),
    ("PM10", "pm10_ugm3", 100.0),
    ("NO₂", "no2_ugm3", 80.0),
    ("SO₂", "so2_ugm3", 80.0),
    ("CO", "co_ugm3", 10000.0),
    ("O₃", "o3_ugm3", 100.0),
]
POLLUTANT_UNIT = "µg/m³"

# ---------------------------------------------------------------------------
# FIXED VALUES - personal exposure risk
# ---------------------------------------------------------------------------
RISK_AQI_BANDS = [(0, 50, 0.00, 0.20), (50, 100, 0.20, 0.40), (100, 200, 0.40, 0.60),
                  (200, 300, 0.60, 0.75), (300, 400, 0.75, 0.90), (400, 500, 0.90, 1.00)]
RISK_AGE_STEPS = [(5, 1.50), (13, 1.30), (18, 1.20), (60, 1.00)]
RISK_AGE_ELDERLY = 1.40
RISK_CONDITIONS = [("respiratory_disease", 0.30), ("heart_disease", 0.25), ("diabetes", 0.15),
                   ("kidney_disease", 0.15), ("is_smoker", 0.20), ("is_pregnant", 0.25)]
ACTIVITY_MULTIPLIERS = {"resting": 0.60, "light": 0.80, "moderate": 1.10, "intense": 1.50}
SENSITIVITY_MULTIPLIERS = {"low": 0.80, "moderate": 1.00, "high": 1.30, "very_high": 1.60}
RISK_CATEGORIES = [(25, "Low"), (50, "Moderate"), (75, "High")]
RISK_TOP_CATEGORY = "Severe"
RISK_RECOMMENDATIONS = {
    "Low": ["Air quality is acceptable for most people.",
            "Sensitive individuals may want to limit prolonged outdoor exertion."],
    "Moderate": ["Consider reducing prolonged outdoor activity.",
                 "Keep windows closed during peak pollution hours (7–10 AM, 6–9 PM)."],
    "High": ["Avoid outdoor exercise. Use N95/FFP2 masks if going out.",
             "Run an air purifier indoors.",
             "Stay hydrated and monitor for symptoms like coughing or shortness of breath."],
    "Severe": ["Stay indoors as much as possible.",
               "Seal gaps around doors/windows.",
               "Seek medical advice if you experience breathing difficulty.",
               "Use an air purifier with HEPA filter."],
}
# condition flag -> advice, in the order they are listed to the user
CONDITION_RECOMMENDATIONS = [
    ("respiratory_disease", "Carry your inhaler/rescue medication."),
    ("heart_disease", "Avoid physical exertion; monitor heart rate."),
    ("diabetes", "Pollution can raise blood sugar — check glucose levels."),
    ("is_pregnant", "Limit outdoor exposure; consult your doctor if AQI > 200."),
    ("is_smoker", "Avoid smoking outdoors; the combined effect is significantly worse."),
    ("kidney_disease", "Stay well hydrated to support kidney function."),
]

# ---------------------------------------------------------------------------
# FIXED VALUES - routes
# ---------------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
ROUTE_SAMPLE_TARGET = 30
ROUTE_NULL_AQI = 100.0
ROUTE_SIMILAR_TOL = 0.08
BALANCED_TIME_WEIGHT = 0.4
BALANCED_AQI_WEIGHT = 0.6
# (fraction along the line, side, offset scale) of the via-point candidates
VIA_CANDIDATES = [(0.50, 1, 1.00), (0.50, -1, 1.00), (0.33, 1, 0.80), (0.67, -1, 0.80),
                  (0.50, 1, 1.60), (0.50, -1, 1.60), (0.33, -1, 1.20), (0.67, 1, 1.20)]
VIA_OFFSET_FACTOR = 0.15
VIA_OFFSET_MIN_KM = 8.0
VIA_OFFSET_MAX_KM = 250.0
KM_PER_DEGREE = 111.0

# ---------------------------------------------------------------------------
# FIXED VALUES - alerts
# ---------------------------------------------------------------------------
DEFAULT_AQI_THRESHOLD = 100
THRESHOLD_COOLDOWN_HOURS = 6
FORECAST_COOLDOWN_HOURS = 12
FORECAST_ALERT_FACTOR = 1.2
NOTIFICATION_TYPES = ["aqi_threshold", "forecast_alert", "risk_alert", "route_saved", "route_monitor"]
ROUTE_COOLDOWN_TIERS = [(72, 36), (24, 18), (6, 4)]
ROUTE_COOLDOWN_MIN = 2
ROUTE_HORIZON_HOURS = 168

# ---------------------------------------------------------------------------
# FIXED VALUES - forecasting
# ---------------------------------------------------------------------------
LAG_HOURS = [24, 48, 72, 168, 336]
ROLLING_MEAN_WINDOWS = [(24, 12), (72, 36), (168, 72), (336, 168)]
ROLLING_STD_WINDOWS = [(168, 72), (72, 36)]
WEATHER_DEFAULTS = {"temperature_c": 20.0, "wind_speed_kmh": 5.0, "humidity_percent": 60.0,
                    "pressure_msl_hpa": 1013.0, "wind_gusts_kmh": 8.0, "precipitation_mm": 0.0}
FORECAST_CLIP_MIN = 0.0
FORECAST_CLIP_MAX = 500.0
INTERVAL_RMSE_FACTOR = 0.8
DEFAULT_RMSE = 40.0
BLEND_HOURLY_WEIGHT = 0.6
BLEND_DAILY_WEIGHT = 0.4
MIN_TRAIN_ROWS = 500
TEST_DAYS = 30

# ---------------------------------------------------------------------------
# FIXED VALUES - health advisory per India AQI band (upper bound inclusive):
# upper bound, range text, category, who is affected, advice for sensitive
# groups, precautions
# ---------------------------------------------------------------------------
AQI_ADVISORY = [
    (50, "0 – 50", "Good", "Safe for everyone.", "No special precautions needed.",
     ["No restrictions. Enjoy outdoor activities freely."]),
    (100, "51 – 100", "Satisfactory", "Acceptable for most people.",
     "Limit prolonged outdoor exertion if you feel discomfort.",
     ["Unusually sensitive people may experience minor irritation."]),
    (200, "101 – 200", "Moderately Polluted", "May cause breathing discomfort on prolonged exposure.",
     "Children, elderly, and those with respiratory/heart conditions should limit outdoor time.",
     ["Avoid prolonged outdoor exercise.",
      "Keep windows closed during peak hours (7–10 AM, 6–9 PM).",
      "Consider wearing a mask outdoors."]),
    (300, "201 – 300", "Poor", "Causes breathing discomfort on prolonged exposure.",
     "Sensitive groups should stay indoors. Keep rescue inhalers and medication handy.",
     ["Avoid all outdoor exercise.",
      "Wear an N95/FFP2 mask when going outside.",
      "Run an air purifier indoors if available.",
      "Stay hydrated."]),
    (400, "301 – 400", "Very Poor", "Causes respiratory illness on prolonged exposure.",
     "Sensitive groups must stay indoors. Seek medical advice if experiencing symptoms.",
     ["Stay indoors as much as possible.",
      "If you must go out, wear an N95 mask.",
      "Seal gaps around doors and windows.",
      "Avoid cooking on open flame — use exhaust fan.",
      "Monitor for symptoms: cough, chest tightness, difficulty breathing."]),
    (None, "401 – 500", "Severe", "Serious health impact on even healthy individuals.",
     "Medical emergency risk. Consult a doctor immediately if symptoms develop.",
     ["Do NOT go outside unless absolutely necessary.",
      "Use N95 mask even indoors if air purifier unavailable.",
      "Seal all doors and windows with wet cloth if needed.",
      "Avoid all physical exertion.",
      "Seek immediate medical help if experiencing chest pain, difficulty breathing, or dizziness."]),
]
SEARCH_SUGGESTIONS = 8
CHART_AXIS_FLOOR = 200

# FIXED VALUES - boosted trees of the hourly model
BOOST_ROUNDS = 1000
BOOST_DEPTH = 7
BOOST_RATE = 0.03
BOOST_SUBSAMPLE = 0.8
BOOST_COLUMNS = 0.75
BOOST_LEAF_ROWS = 3
BOOST_SPLIT_GAIN = 0.1
BOOST_SEED = 42
