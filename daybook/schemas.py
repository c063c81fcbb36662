"""Explicit schemas of the sources and tables; nothing is inferred."""

from __future__ import annotations

PRESS_JSON = "member struct<bioguide_id:string,name:string,party:string,state:string,chamber:string>, date string, title string, url string, domain string, text string"
SENATE_JSON = (
    "filing_uuid string, filing_type string, filing_type_display string, filing_year long, filing_period string, filing_period_display string, income string, expenses string, dt_posted string, "
    "registrant struct<id:string,name:string,description:string,country:string,state:string>, registrant_country string, registrant_state string, client struct<id:string,name:string,general_description:string,description:string>, "
    "lobbying_activities array<struct<general_issue_code:string,description:string,lobbyists:array<struct<lobbyist:struct<first_name:string,last_name:string>,covered_position:string,new:boolean>>,government_entities:array<struct<name:string>>>>, "
    "foreign_entities array<struct<name:string,country:string,ppb_country:string>>"
)
CONTRIBUTIONS_JSON = "filing_uuid string, filer_type string, registrant struct<name:string>, contribution_items array<struct<contribution_type:string,type:string,amount:string,payee_name:string,payee:string,honoree_name:string,honoree:string,contributor_name:string>>"
_LOBBYIST = "struct<lobbyistFirstName:string,lobbyistLastName:string,lobbyistSuffix:string,lobbyistName:string,coveredPosition:string,lobbyistNew:string>"
HOUSE_XML = (
    "senateID string, organizationName string, clientName string, clientGovtEntity string, income string, expenses string, noLobbying string, terminationDate string, signedDate string, reportYear string, reportType string, "
    f"alis struct<ali_info:array<struct<issueAreaCode:string,specific_issues:struct<description:string>,lobbyists:struct<lobbyist:array<{_LOBBYIST}>>>>,ali_Code:array<string>>, specific_issues struct<description:array<string>>, lobbyists struct<lobbyist:array<{_LOBBYIST}>>"
)
FINDINGS_JSON = "findings array<struct<rank:long,score:double,lobbyist_name:string,registrant_name:string,agency_short:string,concentration:double,total_income:double,top_clients_str:string>>"
TRACE_CASE = "lobbyist string, agency string, award_groups array<string>, time_period struct<start:string,end:string>, match array<struct<lobbyist_name:string,agency_short:string>>, clients array<struct<label:string,search:string,name_tokens:array<string>>>"
PRESS_CASE = "case_id string, label string, clients array<struct<name:string,aliases:array<string>>>, filters struct<since:string,until:string,party:string,state:string,chamber:string,domain_contains:string>, match array<struct<lobbyist_name:string,agency_short:string>>"
AWARD = "client string, award_id string, recipient string, amount double, agency string, sub_agency string, award_type string, description string, start_date string"
