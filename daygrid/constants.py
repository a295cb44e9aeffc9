"""Fixed values of the data model.

Everything in this module must equal the published format for results to match: identifiers, channel
order, conversion factors, plausibility limits, bin edges and labels.
"""

MINUTES_PER_DAY = 1440
SECONDS_PER_DAY = 86400

# --- fixed values: modalities, in channel order -----------------------------------------------------
QUANTITY = "healthkit"
WORKOUT = "workout"
SLEEP = "sleep"
MOTION = "motion"
MODALITIES = [QUANTITY, WORKOUT, SLEEP, MOTION]

# --- fixed values: record types, in channel order ---------------------------------------------------
STEP_COUNT = "HKQuantityTypeIdentifierStepCount"
ACTIVE_ENERGY = "HKQuantityTypeIdentifierActiveEnergyBurned"
DISTANCE_WALKING_RUNNING = "HKQuantityTypeIdentifierDistanceWalkingRunning"
DISTANCE_CYCLING = "HKQuantityTypeIdentifierDistanceCycling"
STAND_TIME = "HKQuantityTypeIdentifierAppleStandTime"
HEART_RATE = "HKQuantityTypeIdentifierHeartRate"
QUANTITY_TYPES = [
    STEP_COUNT,
    ACTIVE_ENERGY,
    DISTANCE_WALKING_RUNNING,
    DISTANCE_CYCLING,
    STAND_TIME,
    HEART_RATE,
]

WORKOUT_TYPES = [
    "HKWorkoutActivityTypeWalking",
    "HKWorkoutActivityTypeCycling",
    "HKWorkoutActivityTypeRunning",
    "HKWorkoutActivityTypeOther",
    "HKWorkoutActivityTypeMixedMetabolicCardioTraining",
    "HKWorkoutActivityTypeTraditionalStrengthTraining",
    "HKWorkoutActivityTypeElliptical",
    "HKWorkoutActivityTypeHighIntensityIntervalTraining",
    "HKWorkoutActivityTypeFunctionalStrengthTraining",
    "HKWorkoutActivityTypeYoga",
]
WORKOUT_DEFAULT = "HKWorkoutActivityTypeOther"

ASLEEP = "HKCategoryValueSleepAnalysisAsleep"
IN_BED = "HKCategoryValueSleepAnalysisInBed"
SLEEP_CATEGORIES = [ASLEEP, IN_BED]
SLEEP_TYPE = "HKCategoryTypeIdentifierSleepAnalysis"

MOTION_ACTIVITIES = [
    "stationary",
    "walking",
    "running",
    "automotive",
    "cycling",
    "not available",
]
MOTION_DEFAULT = "not available"
# Order in which the motion distribution report lists the activities.
MOTION_REPORT_ORDER = [
    "stationary",
    "automotive",
    "walking",
    "not available",
    "running",
    "cycling",
]

CHANNELS = QUANTITY_TYPES + WORKOUT_TYPES + SLEEP_CATEGORIES + MOTION_ACTIVITIES
N_CHANNELS = len(CHANNELS)
CHANNEL_INDEX = {name: i for i, name in enumerate(CHANNELS)}

# Channel groups of the coverage report.
CHANNEL_GROUPS = {
    "WorkoutsAny": WORKOUT_TYPES,
    "WorkoutsRunning": ["HKWorkoutActivityTypeRunning"],
    "WorkoutsCycling": ["HKWorkoutActivityTypeCycling"],
    "HeartRate": [HEART_RATE],
    "StepsTaken": [STEP_COUNT],
    "DistanceWalkingRunning": [DISTANCE_WALKING_RUNNING],
    "DistanceCycling": [DISTANCE_CYCLING],
    "ActiveCaloriesBurned": [ACTIVE_ENERGY],
    "SleepAny": SLEEP_CATEGORIES,
}

# --- fixed values: unit conversion (unit -> (standard unit, factor)) --------------------------------
UNIT_FACTORS = {
    "ft": ("m", 0.3048),
    "in": ("m", 0.0254),
    "cm": ("m", 0.01),
    "km": ("m", 1000.0),
    "mi": ("m", 1609.34),
    "lb": ("kg", 0.45359237),
    "g": ("kg", 0.001),
    "mph": ("m/s", 0.44704),
    "fl_oz": ("L", 0.0295735),
}

# --- fixed values: plausibility limits --------------------------------------------------------------
MAX_DURATION_HOURS = 24
MAX_STEPS_PER_SECOND = 5
MAX_ENERGY_PER_SECOND = 250
MAX_WALKING_RUNNING_METRES_PER_SECOND = 10
MAX_CYCLING_METRES_PER_SECOND = 25
MAX_STAND_SECONDS = 1
MAX_STAND_RATE = 1
MIN_HEART_RATE_PER_SECOND = 40 / 60
MAX_HEART_RATE_PER_SECOND = 200 / 60

# Limits to which the per-record rate report clips, per second.
RATE_REPORT_LIMITS = {
    STEP_COUNT: (0, 5),
    ACTIVE_ENERGY: (0, 250),
    DISTANCE_WALKING_RUNNING: (0, 3),
    DISTANCE_CYCLING: (0, 10),
    STAND_TIME: (0, 1),
}

# --- fixed values: midnight split -------------------------------------------------------------------
SPLIT_GAP_SECONDS = 2

# --- fixed values: day quality and windows ----------------------------------------------------------
MIN_CHANNEL_COVERAGE = 10.0
MIN_CHANNELS_WITH_DATA = 3
WINDOW_DAYS = 7
MIN_REQUIRED_DAYS = 5
QUALIFYING_WINDOWS = {"7day": (7, 2), "14day": (14, 4)}  # name -> (days, allowed missing days)
PARTICIPANT_DAY_THRESHOLDS = [1, 3, 7, 14, 30, 365, 1825]
CHANNEL_COUNT_THRESHOLDS = [2, 3, 5, 8, 10, 15, 24]

# --- fixed values: labels ---------------------------------------------------------------------------
LABELS = [
    "sleep_diagnosis1",
    "happiness",
    "heart_disease",
    "feel_worthwhile1",
    "feel_worthwhile2",
    "feel_worthwhile3",
    "Diabetes",
    "Hypertension",
]
LIST_LABELS = ["heart_disease"]
LABEL_KEY_COLUMNS = ["participant_id", "created_on", "file_uris"]
OPEN_SHARING_SCOPE = "all_qualified_researchers"

# --- fixed values: bins (edges are left closed, the last bin is open ended) -------------------------
DAYS_PER_YEAR = 365.25
AGE_BINS = ([18, 25, 35, 45, 55, 65], ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"])
AGE_BINS_FINE = (
    [18, 25, 35, 45, 55, 65, 75],
    ["18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75+"],
)
WEIGHT_BINS = (
    [0, 50, 60, 70, 80, 90, 100],
    ["<50kg", "50-60kg", "60-70kg", "70-80kg", "80-90kg", "90-100kg", ">100kg"],
)
HEIGHT_BINS = (
    [0, 150, 160, 170, 180, 190, 200],
    ["<150cm", "150-160cm", "160-170cm", "170-180cm", "180-190cm", "190-200cm", ">200cm"],
)
UNKNOWN_AGE = "Unknown_Age"
UNKNOWN_WEIGHT = "Unknown_Weight"
UNKNOWN_HEIGHT = "Unknown_Height"
MISSING = "Missing"

# --- fixed values: mask rules -----------------------------------------------------------------------
ALL_CHANNELS_MASKED_MINUTES = 10
HEART_RATE_GAP_MINUTES = 30
STD_EPSILON = 1e-9
REVIN_EPSILON = 1e-5
LOSS_EPSILON = 1e-10
CORRELATION_EPSILON = 1e-9

# --- fixed values: forecasting ----------------------------------------------------------------------
SEGMENT_MINUTES = 30
COMMON_SPLITS = ["5-2d", "7-3d", "10-5d"]
SERIES_FREQ = "T"
