import io
import os
import sys
import zipfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quayline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


# A schedule feed broken on purpose: one violation per rule, columns listed
# alphabetically (a reader that goes by position corrupts them), a BOM on one
# member, leading spaces in feed dates and calendar flags all zero.
MINI_FEED = {
    "agency.txt": "﻿agency_fare_url,agency_id,agency_lang,agency_name,agency_phone,agency_timezone,agency_url\n"
                  ",AGX,fr,Rail Co,,Europe/Brussels,http://rail.example\n",
    "feed_info.txt": "feed_id,default_lang,feed_contact_email,feed_contact_url,feed_end_date,feed_lang,"
                     "feed_publisher_name,feed_publisher_url,feed_start_date,feed_version\n"
                     "F1,fr,,, 20250131,fr,Rail Co,http://rail.example, 20250101,v7\n",
    "stops.txt": "location_type,parent_station,platform_code,stop_code,stop_desc,stop_id,stop_lat,stop_lon,stop_name,"
                 "stop_url,wheelchair_boarding,zone_id\n"
                 "1,,,,,S1,50.1,4.1,Alpha,,1,\n"
                 "1,,,,,S2,50.2,4.2,Beta,,,\n"
                 "0,S1,1,,,P1a,50.1,4.1,Alpha,,,\n"
                 "0,S1,2,,,P1b,50.1,4.1,Alpha,,,\n"
                 "0,S1,,,,P1c,50.1,4.1,Alpha,,,\n"
                 "0,S2,1,,,P2a,50.2,4.2,Beta,,,\n"
                 "0,S2,,,,P2b,50.2,4.2,Beta,,,\n"
                 "0,S9,3,,,P9,50.9,4.9,Nowhere,,,\n"
                 "2,S1,,,,E1,50.1,4.1,Alpha entrance,,,\n",
    "routes.txt": "agency_id,route_color,route_desc,route_id,route_long_name,route_short_name,route_text_color,"
                  "route_type,route_url\n"
                  "AGX,,,R1,Alpha - Beta,IC,,2,\n"
                  "AGX,,,R2,Beta local,L,,2,\n",
    "calendar.txt": "end_date,friday,monday,saturday,service_id,start_date,sunday,thursday,tuesday,wednesday\n"
                    "20250112,0,0,0,WK,20250106,0,0,0,0\n"
                    "20250112,0,0,0,WE,20250106,0,0,0,0\n"
                    "20250107,0,0,0,ONE,20250107,0,0,0,0\n",
    "calendar_dates.txt": "date,exception_type,service_id\n"
                          "20250106,1,WK\n20250107,1,WK\n20250108,1,WK\n20250109,1,WK\n20250110,1,WK\n"
                          "20250111,1,WE\n20250112,1,WE\n"
                          "20250107,1,ONE\n"
                          "20250106,1,WK\n"
                          "20250106,1,GHOST\n",
    "trips.txt": "bikes_allowed,block_id,direction_id,route_id,service_id,shape_id,trip_headsign,trip_id,"
                 "trip_short_name,wheelchair_accessible\n"
                 "1,,0,R1,WK,,Beta,T1,101,\n"
                 "2,,1,R1,WE,,Alpha,T2,102,1\n"
                 ",,0,R2,ONE,,Beta,T3,201,0\n"
                 "0,,1,R2,WK,,Gamma,T4,202,2\n"
                 "0,,0,R9,WK,,Nowhere,T5,999,0\n",
    "stop_times.txt": "arrival_time,departure_time,drop_off_type,pickup_type,shape_dist_traveled,stop_headsign,"
                      "stop_id,stop_sequence,trip_id\n"
                      "08:00:00,08:00:00,0,0,,,P1a,1,T1\n"
                      "08:29:00,08:30:00,0,0,,,P2a,2,T1\n"
                      "08:30:00,08:31:00,0,0,,,P2a,2,T1\n"
                      "24:10:00,24:10:00,0,0,,,P1b,1,T2\n"
                      "25:00:00,25:00:00,1,1,,,P2a,2,T2\n"
                      "07:00:00,07:00:00,0,0,,,P1a,abc,T3\n"
                      "09:00:00,09:00:00,0,0,,,P2b,2,T3\n"
                      "87:39:00,87:39:00,0,0,,,P1c,1,T4\n"
                      "13:00:00,13:00:00,0,0,,,P2a,2,T4\n"
                      "10:00:00,10:00:00,0,0,,,P1a,1,TX\n"
                      "09:00:00,09:00:00,0,0,,,P404,3,T1\n"
                      ",,0,0,,,P2a,3,T3\n",
    "transfers.txt": "from_stop_id,min_transfer_time,to_stop_id,transfer_type,from_trip_id,to_trip_id\n"
                     "P1a,180,P1b,2,,\n"
                     "P1a,,P404,0,,\n",
    "translations.txt": "table_name,field_name,record_id,record_sub_id,field_value,language,translation\n"
                        "stops,stop_name,,,Alpha,nl,Alfa\n"
                        "stops,stop_name,,,Alpha,de,Alpha DE\n"
                        "stops,stop_name,,,Beta,xx,Beta XX\n",
}


def write_feed(path, members=MINI_FEED):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in members.items():
            z.writestr(name, text.encode("utf-8"))
    path.write_bytes(buf.getvalue())
    return path


@pytest.fixture(scope="session")
def feed_tables(spark, tmp_path_factory):
    from quayline import pipeline

    d = tmp_path_factory.mktemp("feed")
    write_feed(d / "mini.zip")
    t = pipeline.feed_core(spark, str(d))
    t = {k: (v.cache() if hasattr(v, "cache") else v) for k, v in t.items()}
    return pipeline.add_views(t)
