"""Declared schemas of the formats that the readers take."""

LOCATION = "name string, center array<float>, additional_info string"
PLACE_CONTENT = (
    "array<struct<name: map<string,string>, categories: array<string>, centroid: array<double>, "
    "address: map<string,string>, country_code: string, geometry: struct<type: string, coordinates: variant>>>"
)
PLACE_DUMP = f"type string, content {PLACE_CONTENT}"
AUGMENTED = "name string, center array<double>, categories array<string>, additional_info string"
SITE_XML = "Location array<struct<LocationName: string, LocationType: string, Coordinates: string>>"
DEM = "tile_lat int, tile_lon int, r int, c int, h int"
DOWNLOAD = (
    "id string, name string, createdAt bigint, bounds array<double>, gridSize double, baseLayerName string, tileLayers array<string>, "
    "tileZooms array<int>, tileCount bigint, siteCount bigint, status string, lastError string, updatedAt bigint, totalBytes bigint"
)
