"""Explicit schemas of every table the package reads; nothing is inferred.

``pos`` is the input order of a row.  Several results depend on it (first team
file wins, last duplicate tag wins, greedy grouping), so it is a real column
that comes from the source and never from ``monotonically_increasing_id``.
"""

TAG = "struct<key:string,value:string>"
STORED_TAG = "struct<id:string,key:string,value:string>"

ASSET = f"""asset_id string, pos bigint, type string, tags array<{TAG}>, ip string, hostname string,
 assetName string, repository string, imageName string, cloudProvider string, account string,
 region string, applicationId string"""

ASSET_STRUCT = "struct<" + ", ".join(
    part.strip().replace(" ", ":", 1) for part in
    ASSET.replace("\n", " ").split(", ")) + ">"

# One page of a saved listing: the rows, plus what the service declared about the whole.
ASSET_PAGE = f"content array<{ASSET_STRUCT}>, last boolean"

ACTUAL_SCOPE = f"id string, name string, type string, tags array<{STORED_TAG}>, pos bigint"
ACTUAL_COMPONENT = f"id string, name string, applicationId string, tags array<{STORED_TAG}>, pos bigint"


def page_of(row_schema: str) -> str:
    """Schema of a page whose ``content`` holds rows of ``row_schema``."""
    fields = _top_level_fields(row_schema)
    body = ", ".join(f"{name}:{dtype}" for name, dtype in fields)
    return f"content array<struct<{body}>>, totalElements bigint, last boolean"


def _top_level_fields(ddl: str) -> list[tuple[str, str]]:
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    parts.append(ddl[start:])
    return [tuple(part.strip().split(None, 1)) for part in parts]


INTEGRATION = "struct<TIntegrationName:string,MIntegrationName:string,IntegrationName:string,Backlog:string,Channel:string>"

RULE = """struct<RepositoryName:array<string>,SearchName:string,Tags:array<string>,Tag:string,
 Tag_rule:array<string>,Tags_rule:array<string>,Tag_label:array<string>,Tags_label:array<string>,
 Cidr:string,Cidrs:array<string>,Fqdn:array<string>,Netbios:array<string>,OsNames:array<string>,
 Hostnames:array<string>,ProviderAccountId:array<string>,AccountId:array<string>,
 ProviderAccountName:array<string>,ResourceGroup:array<string>,AssetType:string,Tag_rule_text:boolean>""".replace("\n", "")

USER = "email string, name string, role string"
TEAM = "id string, name string"
TEAM_MEMBER = "team_id string, email string"
