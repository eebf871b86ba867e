"""Small source files of our own, with the quirks that FIXTURES.md lists, and tables that fit them."""

LEAVE_CSV = """\
/* absences, first quarter */
leave_id,employee_id,leave_type,start_date,end_date,approval_status
A-1,11,Parental,2025-03-03,2025-03-13,Approved
A-2,13,Training,2025-04-07,2025-04-10,Pending
A-3,12,Unpaid,2025-05-05,2025-05-07,Approved
A-4,77,Sabbatical,2025-03-01,2025-03-31,Approved
/* 77 has left */"""

ROUTES_CSV = """\
/* trips */
/* miles and gallons */
dispatch_id,vehicle_id,distance_miles,hours_taken,fuel_consumed_gallons,status
R-1,41,200.0,4.0,16.0,Completed
R-2,43,90.0,1.5,0.0,Completed
R-3,47,33.5,0.5,2.5,Completed
R-4,42,610.5,11.0,55.5,Delayed
/* 47 is rented */"""

TICKETS_JSON = """\
/* one object per line */
{"ticket_id": "S-1", "agent_id": 22, "customer_id": 61, "priority": "High", "response_time_minutes": 50, "resolved": true}
{"ticket_id": "S-2", "agent_id": 21, "customer_id": 62, "priority": "Critical", "response_time_minutes": 9, "resolved": true}
{"ticket_id": "S-3", "agent_id": 22, "customer_id": 61, "priority": "Critical", "response_time_minutes": 14, "resolved": false}
{"ticket_id": "S-4", "agent_id": 99, "customer_id": 63, "priority": "Low", "response_time_minutes": 121, "resolved": false}
/* 99 is a robot */"""

TRANSACTIONS_JSON = """\
/* an array over several lines */
[
  {"transaction_id": "B-1", "customer_id": 52, "amount": 12.25, "txn_timestamp": "2025-02-01T10:00:00Z"},
  {"transaction_id": "B-2", "customer_id": 51, "amount": 310.00, "txn_timestamp": "2025-02-02T09:00:00Z"},
  {"transaction_id": "B-3", "customer_id": 52, "amount": 20.25, "txn_timestamp": "2025-02-03T12:30:00Z"},
  {"transaction_id": "B-4", "customer_id": 59, "amount": 7.50, "txn_timestamp": "2025-02-04T18:45:00Z"}
]
/* 59 never signed up */"""


def customers(spark):
    rows = [(51, "Ann", "Gold"), (52, "Bo", "Silver"), (53, "Cy", "Gold")]
    return spark.createDataFrame(rows, "customer_id int, first_name string, tier string")


def employees(spark):
    rows = [(11, "X", 110.0, "Active"), (12, "Y", 220.0, "Active"), (13, "Z", 330.0, "Active")]
    return spark.createDataFrame(rows, "employee_id int, department string, salary_usd double, status string")


def vehicles(spark):
    rows = [(41, "P1", "M1"), (42, "P2", "M2"), (43, "P3", "M3")]
    return spark.createDataFrame(rows, "vehicle_id int, plate_number string, model string")


def agents(spark):
    rows = [(21, "Ada", "Lane", "T1"), (22, "Ben", "Moss", "T2"), (23, "Cat", "Nash", "T1")]
    return spark.createDataFrame(rows, "agent_id int, first_name string, last_name string, tier_level string")


def silver_of(spark, tmp_path, name, text):
    """Text file -> Bronze -> Silver, the way a run does it."""
    from stratalake import Lake, build_silver, load_bronze, read_source
    from stratalake.functions.names import bronze_name, silver_name

    path = tmp_path / name
    path.write_text(text)
    lake = Lake(spark, str(tmp_path / f"lake-{path.stem}"))
    table = bronze_name(str(path))
    load_bronze(lake, table, read_source(spark, str(path)), str(path))
    load = build_silver(lake, table)
    return lake.read("bronze", table), lake.read("silver", silver_name(table)), load
